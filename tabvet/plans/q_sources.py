"""Source / sink queries.  Round trips write a table derived
from the driver's tables into the shared scratch area and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.operators import typing as TY
from tabvet.operators.rules import RuleSet
from tabvet.plans.flagship import FLAGSHIP_RULES
from tabvet.plans.registry import query, r6
from tabvet.session import table
from tabvet.sources import io as IO

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def _customer_csv(spark, sf, sep):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    path = IO.scratch_path(spark, "customer.csv")
    c.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def _typed(df):
    return df.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
                     r6(F.col("c_acctbal").cast("double")).alias("c_acctbal"), "c_mktsegment")


_CUST = "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer"


@query("a01_load_csv_semicolon", _CUST)
def a01_load_csv_semicolon(spark, sf):
    return _typed(IO.load_csv(spark, _customer_csv(spark, sf, ";"), ";"))


@query("a02_load_csv_sniffed", _CUST)
def a02_load_csv_sniffed(spark, sf):
    return _typed(IO.load_csv_sniffed(spark, _customer_csv(spark, sf, ",")))


@query("a03_load_parquet", _CUST)
def a03_load_parquet(spark, sf):
    return _typed(IO.load_table(spark, f"{sf.rstrip('/')}/customer.parquet"))


@query("a04_sample_rows", f"""
SELECT o_orderkey FROM orders ORDER BY {hu_sql(42, 'o_orderkey')}, o_orderkey LIMIT 1000""")
def a04_sample_rows(spark, sf):
    return IO.sample_rows(table(spark, sf, "orders"), 1000, "o_orderkey").select("o_orderkey")


_FLAG_COUNTS = """
WITH v AS (
  SELECT coalesce(c_acctbal >= 0, false) AS acctbal_nonneg,
         coalesce(c_acctbal BETWEEN -999 AND 9000, false) AS acctbal_range,
         coalesce(c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD'), false) AS segment_known,
         (coalesce(c_acctbal > 100, false) OR coalesce(c_nationkey < 5, false)) AS rich_or_local,
         CASE WHEN coalesce(c_mktsegment = 'BUILDING', false) THEN coalesce(c_acctbal >= 500, false) ELSE true END AS building_min
  FROM customer)
SELECT 'acctbal_nonneg' AS rule, CAST(count(*) FILTER (WHERE NOT acctbal_nonneg) AS BIGINT) AS violations FROM v
UNION ALL SELECT 'acctbal_range', count(*) FILTER (WHERE NOT acctbal_range) FROM v
UNION ALL SELECT 'segment_known', count(*) FILTER (WHERE NOT segment_known) FROM v
UNION ALL SELECT 'rich_or_local', count(*) FILTER (WHERE NOT rich_or_local) FROM v
UNION ALL SELECT 'building_min', count(*) FILTER (WHERE NOT building_min) FROM v"""


@query("a05_load_rules", _FLAG_COUNTS)
def a05_load_rules(spark, sf):
    # rules shipped as a text file (name: rule, with a comment line)
    lines = ["# flagship rules"] + [f"{n}: {r}" for n, r, _ in FLAGSHIP_RULES]
    path = IO.scratch_path(spark, "rules.txt")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)
    rules = IO.load_rules(spark, path)
    rs = RuleSet([(r["name"], r["rule"]) for r in rules.collect()])
    return rs.violation_counts(table(spark, sf, "customer")).select("rule", "violations")


@query("a06_rule_table_roundtrip", _FLAG_COUNTS)
def a06_rule_table_roundtrip(spark, sf):
    rs = RuleSet([(n, r) for n, r, _ in FLAGSHIP_RULES])
    counts = rs.violation_counts(table(spark, sf, "customer"))
    path = IO.scratch_path(spark, "rules.json")
    IO.save_rules(rs, counts, path)
    back = IO.load_rule_table(spark, path)
    reloaded = RuleSet([(r["rule"], r["raw"]) for r in back.collect()])
    return reloaded.violation_counts(table(spark, sf, "customer")).select("rule", "violations")


@query("a07_schema_roundtrip", """
SELECT 'o_orderkey' AS feature, 'continuous' AS feature_type UNION ALL SELECT 'o_orderstatus', 'categorical'
UNION ALL SELECT 'o_totalprice', 'continuous' UNION ALL SELECT 'o_orderdate', 'datetime'
UNION ALL SELECT 'o_orderpriority', 'categorical'""")
def a07_schema_roundtrip(spark, sf):
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    fs = TY.feature_schema(table(spark, sf, "orders"), cols)
    path = IO.scratch_path(spark, "schema.json")
    IO.save_schema(fs, path)
    back = IO.load_schema(spark, path, "feature string, feature_type string, min_value double, max_value double, "
                                       "scaling string, encoding string, output_dim int, default_value string")
    return back.select("feature", "feature_type")


@query("a08_sink_results", """
WITH q AS (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [0.05, 0.5, 0.95]) AS q FROM orders)
SELECT CAST(count(*) AS BIGINT) AS rows, round(avg((CAST(o_totalprice AS DOUBLE) - q[2]) / (q[3] - q[1])), 6) AS mean_encoded FROM orders, q""")
def a08_sink_results(spark, sf):
    from tabvet.operators import encode as E
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    enc = E.ContinuousEncoder(["o_totalprice"], "robust").fit(o)
    meta = spark.createDataFrame([(c, p["center"], p["scale"]) for c, p in enc.params.items()],
                                 "feature string, center double, scale double")
    valid = o.agg(F.count(F.lit(1)).alias("rows"))
    report = spark.createDataFrame([("transformation report",)], "value string")
    root = IO.scratch_path(spark, "results")
    paths = IO.save_results(enc.transform(o), meta, valid, report, root)
    back = spark.read.parquet(paths["transformed_data.parquet"])
    return back.agg(F.count(F.lit(1)).alias("rows"), r6(F.avg("o_totalprice")).alias("mean_encoded"))


@query("a09_sink_generated", "SELECT CAST(count(*) AS BIGINT) AS rows, 'csv' AS format FROM orders")
def a09_sink_generated(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    path = IO.scratch_path(spark, "generated.csv")
    IO.save_generated(o, path)
    back = IO.load_csv(spark, path, ",")
    return back.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit("csv").alias("format"))


@query("a10_metric_log_csv", "SELECT event_type AS metric, CAST(count(*) AS BIGINT) AS readings FROM events GROUP BY event_type")
def a10_metric_log_csv(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("metric"), "value", F.col("ts").alias("timestamp"))
    path = IO.scratch_path(spark, "metrics.csv")
    IO.save_metric_log(e, path)
    back = IO.load_csv(spark, path, ",")
    return back.groupBy("metric").agg(F.count(F.lit(1)).alias("readings"))


@query("a11_first_rows", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def a11_first_rows(spark, sf):
    return IO.first_rows(table(spark, sf, "orders"), 100, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("a12_train_test_split", f"""
SELECT {hu_sql(42, 'o_orderkey')} < 0.3 AS is_test, CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1""")
def a12_train_test_split(spark, sf):
    s = IO.train_test_split(table(spark, sf, "orders"), "o_orderkey")
    return s.groupBy("is_test").agg(F.count(F.lit(1)).alias("rows"))




@query("a13_load_summary", " UNION ALL ".join(
    f"SELECT '{t}' AS \"table\", CAST(count(*) AS BIGINT) AS rows, "
    f"(SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE {t})) AS columns FROM {t}" for t in TABLES))
def a13_load_summary(spark, sf):
    parts = [IO.load_summary(table(spark, sf, t), t) for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
