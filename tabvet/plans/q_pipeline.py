"""Whole-table encoding and preparation queries (D28, D31) and their
reports (L10-L12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators import encode as E
from tabvet.operators import fidelity as FI
from tabvet.plans.q_encode import _DT_SQL, _cats_sql, _onehot_sql, _z
from tabvet.plans.q_fidelity import CAT_O, NUM_O, pair_orders
from tabvet.plans.q_typing import _DEEP_SQL, _deep, _orders_x, ORD_COLS
from tabvet.plans.registry import query, r6
from tabvet.session import table

D31_COLS = ["o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"]


def _robust(c):
    return (f"round(({c} - (SELECT quantile_cont({c}, 0.5) FROM orders)) / "
            f"((SELECT quantile_cont({c}, 0.95) - quantile_cont({c}, 0.05) FROM orders)), 6) AS {c}")


@query("d31_fit_transform", f"""
WITH {_cats_sql('o_orderstatus', 'orders')}, {_cats_sql('o_orderpriority', 'orders')}, {_DT_SQL},
enc AS (SELECT o.o_orderkey, {_robust('o_totalprice')}, {_robust('o_custkey')},
  {_onehot_sql('o_orderstatus', 3)}, {_onehot_sql('o_orderpriority', 5)} FROM orders o),
dz AS (SELECT o_orderkey, {_z('y', 'o_orderdate_year')}, {_z('mo', 'o_orderdate_month')}, {_z('d', 'o_orderdate_day')},
  {_z('h', 'o_orderdate_hour')}, {_z('dow', 'o_orderdate_dayofweek')}, {_z('we', 'o_orderdate_is_weekend')} FROM dt)
SELECT * FROM enc JOIN dz USING (o_orderkey)""")
def d31_fit_transform(spark, sf):
    o = table(spark, sf, "orders")
    te = E.TableEncoder.infer(o, D31_COLS).fit(o)
    out = te.transform(o, keep=["o_orderkey"])
    return out.select("o_orderkey", *[r6(c).alias(c) if c.startswith(("o_totalprice", "o_custkey", "o_orderdate"))
                                      else F.col(c) for c in out.columns if c != "o_orderkey"])


@query("d31_inverse_transform", """
SELECT o_orderkey, o_orderstatus, o_orderpriority, round(CAST(o_totalprice AS DOUBLE), 2) AS o_totalprice,
  round(CAST(o_custkey AS DOUBLE), 2) AS o_custkey, make_timestamp(year(o_orderdate), month(o_orderdate), least(day(o_orderdate), 28), hour(o_orderdate), 0, 0) AS o_orderdate
FROM orders""")
def d31_inverse_transform(spark, sf):
    o = table(spark, sf, "orders")
    te = E.TableEncoder.infer(o, D31_COLS).fit(o)
    back = te.inverse_transform(te.transform(o, keep=["o_orderkey"]), keep=["o_orderkey"])
    return back.select("o_orderkey", "o_orderstatus", "o_orderpriority", r6("o_totalprice", 2).alias("o_totalprice"),
                       r6("o_custkey", 2).alias("o_custkey"), F.date_trunc("hour", "o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@query("d28_prepare")
def d28_prepare(spark, sf):
    prepared, _ = E.prepare(_orders_x(spark, sf), ORD_COLS[1:], "o_orderkey")
    return prepared.select(*[r6(c).alias(c) if c != "o_orderkey" else F.col(c) for c in prepared.columns])


@query("d28_prepare_balanced", """
SELECT o_orderstatus, false AS synthetic, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'P', true, CAST(count(*) - 2 * count(*) FILTER (o_orderstatus = 'P') AS BIGINT) FROM orders
HAVING count(*) > 2 * count(*) FILTER (o_orderstatus = 'P')""")
def d28_prepare_balanced(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderpriority", "o_orderstatus")
    out, _ = E.prepare(o, ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderkey", balance=("o_orderstatus", "P"))
    return out.groupBy("o_orderstatus", "synthetic").agg(F.count(F.lit(1)).alias("rows"))


@query("l10_deep_type_distribution", f"WITH {_DEEP_SQL} SELECT deep_type, CAST(count(*) AS BIGINT) AS n FROM deep GROUP BY deep_type")
def l10_deep_type_distribution(spark, sf):
    return _deep(spark, sf).groupBy("deep_type").agg(F.count(F.lit(1)).alias("n"))


@query("l11_preparation_summary")
def l11_preparation_summary(spark, sf):
    prepared, report = E.prepare(_orders_x(spark, sf), ORD_COLS[1:], "o_orderkey")
    out_dims = len(prepared.columns) - 1
    rows = prepared.agg(F.count(F.lit(1)).alias("rows"))
    summ = report.agg(F.count(F.lit(1)).alias("features_in"),
                      F.sum("output_dimensions").alias("features_out"),
                      F.count_if(F.col("transformation") != "continuous").alias("interventions"),
                      F.count_if(F.col("warning").isNotNull()).alias("warnings"))
    k = F.lit(1)
    return summ.withColumn("_k", k).join(rows.withColumn("_k", k), "_k").drop("_k") \
        .withColumn("prepared_columns", F.lit(out_dims))


@query("l12_audit_report")
def l12_audit_report(spark, sf):
    """Audit results as JSON lines and Markdown table lines (HTML dropped)."""
    real, synth = pair_orders(spark, sf)
    a = FI.audit(real, synth, NUM_O, CAT_O, ["ks", "wasserstein", "js_categorical"])
    js = a.select(F.lit("json").alias("format"), F.to_json(F.struct("test", "feature", "metric", "value")).alias("line"))
    md = a.select(F.lit("markdown").alias("format"),
                  F.format_string("| %s | %s | %s | %.6f |", "test", F.coalesce("feature", F.lit("-")), "metric",
                                  F.coalesce("value", F.lit(float("nan")))).alias("line"))
    return js.unionByName(md)
