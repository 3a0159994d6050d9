"""Generation and resampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.operators import generate as G
from tabvet.operators.dependent import dependent_synthesis
from tabvet.operators.rules import RuleSet
from tabvet.plans.registry import query, r6
from tabvet.session import table


def _orders(spark, sf):
    return table(spark, sf, "orders")


_IDX = """idx AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS r, * FROM orders),
ids AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders),
nr AS (SELECT count(*) AS n FROM orders)"""


def _boot_sql(seed):
    return f"""boot AS (SELECT row_id, idx.* FROM ids, nr JOIN idx ON idx.r = CAST(floor({hu_sql(seed, 'row_id')} * n) + 1 AS BIGINT))"""


@query("k01_bootstrap", f"WITH {_IDX}, {_boot_sql(1)} SELECT row_id, o_orderkey FROM boot")
def k01_bootstrap(spark, sf):
    o = _orders(spark, sf)
    return G.bootstrap(spark, o, "o_orderkey", o.count(), seed=1).select("row_id", "o_orderkey")


def _cat_sql(col, seed, given=None, src="orders", rows="ids"):
    g = f"{given}, " if given else ""
    on = f"USING ({given})" if given else "ON true"
    return f"""ct AS (SELECT {g}CAST({col} AS VARCHAR) AS v, count(*) AS n FROM {src} GROUP BY ALL),
cc AS (SELECT {g}v, sum(n) OVER (PARTITION BY {given or '1'} ORDER BY v) AS cum, sum(n) OVER (PARTITION BY {given or '1'}) AS tot FROM ct),
dr AS (SELECT row_id, {g}arg_min(v, cum) FILTER (WHERE cum > u * tot) AS {col}
       FROM (SELECT {rows}.*, {hu_sql(seed, 'row_id')} AS u FROM {rows}) q JOIN cc {on} GROUP BY row_id{', ' + given if given else ''})"""


@query("k02_categorical_draw", f"WITH {_IDX}, {_cat_sql('o_orderpriority', 2)} SELECT row_id, o_orderpriority FROM dr")
def k02_categorical_draw(spark, sf):
    o = _orders(spark, sf)
    ids = spark.range(o.count()).withColumnRenamed("id", "row_id")
    return G.draw_categorical(ids, G.categorical_table(o, "o_orderpriority"), [], "o_orderpriority", "row_id", 2)


def _nd(seed, key):
    u1 = f"greatest({hu_sql(f'{seed}a', key)}, 1e-300)"
    u2 = hu_sql(f"{seed}b", key)
    return f"(sqrt(-2.0 * ln({u1})) * cos(2 * 3.141592653589793 * {u2}))"


@query("k03_gaussian_draw", f"""WITH {_IDX}, {_boot_sql(3)},
gs AS (SELECT o_orderstatus, avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY o_orderstatus)
SELECT row_id, boot.o_orderstatus, round(mu + coalesce(sd, 0) * {_nd(4, 'row_id')}, 4) AS o_totalprice
FROM boot JOIN gs USING (o_orderstatus)""")
def k03_gaussian_draw(spark, sf):
    o = _orders(spark, sf)
    b = G.bootstrap(spark, o, "o_orderkey", o.count(), seed=3).select("row_id", "o_orderstatus")
    d = G.draw_gaussian(b, G.gaussian_table(o, "o_totalprice", ["o_orderstatus"]), ["o_orderstatus"], "o_totalprice",
                        "row_id", 4)
    return d.select("row_id", "o_orderstatus", r6("o_totalprice", 4).alias("o_totalprice"))


@query("k04_mixture_draw")
def k04_mixture_draw(spark, sf):
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler
    o = _orders(spark, sf)
    feats = VectorAssembler(inputCols=["o_totalprice"], outputCol="features").transform(o.select("o_totalprice"))
    gm = GaussianMixture(k=3, seed=42, featuresCol="features").fit(feats)
    w = list(gm.weights)
    g = gm.gaussiansDF.collect()
    means = [float(r["mean"][0]) for r in g]
    stds = [float(r["cov"].toArray()[0][0]) ** 0.5 for r in g]
    ids = spark.range(o.count()).withColumnRenamed("id", "row_id")
    return G.draw_mixture(ids, w, means, stds, "o_totalprice", "row_id", 5).select(
        "row_id", "o_totalprice_component", r6("o_totalprice", 2).alias("o_totalprice"))


_K5_SQL = f"""{_IDX}, {_boot_sql(7)},
cond AS (SELECT row_id, o_orderstatus FROM boot),
{_cat_sql('o_orderpriority', '7:0', 'o_orderstatus', rows='cond')},
gs AS (SELECT o_orderstatus, avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders GROUP BY o_orderstatus),
syn AS (SELECT dr.row_id, dr.o_orderstatus, dr.o_orderpriority, mu + coalesce(sd, 0) * {_nd('7:g0', 'dr.row_id')} AS o_totalprice
        FROM dr JOIN gs USING (o_orderstatus))"""


def _k5(spark, sf):
    o = _orders(spark, sf)
    return G.conditional_synthesis(spark, o, "o_orderkey", o.count(), "o_orderstatus", ["o_orderpriority"],
                                   ["o_totalprice"], seed=7)


@query("k05_conditional_synthesis", f"""WITH {_K5_SQL}
SELECT row_id, o_orderstatus, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM syn""")
def k05_conditional_synthesis(spark, sf):
    return _k5(spark, sf).select("row_id", "o_orderstatus", "o_orderpriority", r6("o_totalprice", 4).alias("o_totalprice"))


_K5D_COLS = [("is_big", []), ("o_orderstatus", []), ("o_totalprice", ["is_big"]),
             ("o_orderpriority", ["o_orderstatus", "is_big"]), ("o_orderdate", ["o_totalprice"])]
_K5D_EDGES = [("is_big", "o_totalprice", 0.9), ("o_orderstatus", "o_orderpriority", 0.5), ("is_big", "o_orderpriority", 0.4),
              ("o_totalprice", "o_orderdate", 0.3)]


def _k5d_sql() -> str:
    """Ancestral draws column by column; every drawn configuration is a real one here."""
    edge = "list_sort(list_distinct([" + ", ".join("quantile_cont({x}, %r)" % (i / 8) for i in range(9)) + "]))"
    code = "CAST(len(list_filter(e_{c}[2:len(e_{c}) - 1], lambda b: b < {x})) AS VARCHAR)"
    price, day = "o_totalprice", "CAST(epoch(o_orderdate) AS DOUBLE)"
    out = f"""e AS (SELECT {edge.format(x=price)} AS e_p, {edge.format(x=day)} AS e_d FROM orders),
codes AS (SELECT '=' || CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS is_big, '=' || o_orderstatus AS o_orderstatus,
  {code.format(c='p', x=price)} AS o_totalprice, '=' || o_orderpriority AS o_orderpriority, {code.format(c='d', x=day)} AS o_orderdate
  FROM orders, e),
d0 AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id FROM orders)"""
    for k, (c, given) in enumerate(_K5D_COLS, 1):
        g = "".join(f"{x}, " for x in given)
        part = f"PARTITION BY {', '.join(given)}" if given else ""
        on = f"USING ({', '.join(given)})" if given else "ON true"
        out += f""",
c{k} AS (SELECT {g}v, sum(n) OVER ({part} ORDER BY v) AS cum, sum(n) OVER ({part}) AS tot
  FROM (SELECT {g}{c} AS v, count(*) AS n FROM codes GROUP BY ALL)),
d{k} AS (SELECT d.*, x.{c} FROM d{k - 1} d JOIN (SELECT row_id, arg_min(v, cum) FILTER (WHERE cum > u * tot) AS {c}
  FROM (SELECT *, {hu_sql(f'7:{c}', 'row_id')} AS u FROM d{k - 1}) q JOIN c{k} {on} GROUP BY row_id) x USING (row_id))"""
    return out


@query("k05_dependent_synthesis", f"""WITH {_k5d_sql()}
SELECT row_id, substr(is_big, 2) AS is_big, substr(o_orderstatus, 2) AS o_orderstatus, substr(o_orderpriority, 2) AS o_orderpriority,
  round(e_p[CAST(o_totalprice AS INT) + 1] + {hu_sql('7:o_totalprice:v', 'row_id')}
        * (e_p[CAST(o_totalprice AS INT) + 2] - e_p[CAST(o_totalprice AS INT) + 1]), 4) AS o_totalprice,
  CAST(round(e_d[CAST(o_orderdate AS INT) + 1] + {hu_sql('7:o_orderdate:v', 'row_id')}
        * (e_d[CAST(o_orderdate AS INT) + 2] - e_d[CAST(o_orderdate AS INT) + 1])) AS BIGINT) AS order_second
FROM d{len(_K5D_COLS)}, e""")
def k05_dependent_synthesis(spark, sf):
    o = _orders(spark, sf).withColumn("is_big", F.when(F.col("o_totalprice") > 200000, "big").otherwise("small"))
    d = dependent_synthesis(spark, o, o.count(), _K5D_EDGES, ["is_big", "o_orderstatus", "o_orderpriority"], ["o_totalprice"],
                            ["o_orderdate"], bins=8, seed=7)
    return d.select("row_id", "is_big", "o_orderstatus", "o_orderpriority", r6("o_totalprice", 4).alias("o_totalprice"),
                    F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("order_second"))


@query("k06_smote")
def k06_smote(spark, sf):
    lab = table(spark, sf, "labels")
    d = lab.join(table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars")), "doc_id")
    d = d.select("doc_id", F.col("quality").cast("double").alias("quality"), "n_chars", "toxic")
    out = G.smote(spark, d, "toxic", 1, "doc_id", ["quality", "n_chars"], k=5)
    return out.groupBy("toxic", "synthetic").agg(F.count(F.lit(1)).alias("rows"),
                                                 r6(F.avg("n_chars"), 2).alias("mean_n_chars"))


@query("k07_constraint_generation", f"""WITH {_K5_SQL},
enf AS (SELECT row_id, o_orderstatus, o_orderpriority, least(greatest(o_totalprice, 1000.0), 400000.0) AS o_totalprice FROM syn)
SELECT row_id, o_orderstatus, o_orderpriority, round(o_totalprice, 4) AS o_totalprice FROM enf
WHERE coalesce(o_orderpriority <> '5-LOW', false) AND coalesce(o_totalprice BETWEEN 1000 AND 400000, false)""")
def k07_constraint_generation(spark, sf):
    gen = _k5(spark, sf)
    rules = RuleSet([("price_range", "o_totalprice BETWEEN 1000 AND 400000"), ("not_low", "o_orderpriority != '5-LOW'")])
    out = rules.filter_valid(rules.enforce(gen))
    return out.select("row_id", "o_orderstatus", "o_orderpriority", r6("o_totalprice", 4).alias("o_totalprice"))
