"""Privacy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.operators import privacy as PV
from tabvet.plans.q_fidelity import CAT_O, NUM_O, _PAIR_O, pair_orders
from tabvet.plans.registry import query, r6
from tabvet.session import table

KNN_COLS = ["acctbal", "nationkey"]


def knn_pair(spark, sf):
    real = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"),
                                               F.col("c_nationkey").cast("double").alias("nationkey"))
    synth = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"),
                                                F.col("s_nationkey").cast("double").alias("nationkey"))
    return real, synth


_KNN_SQL = """r AS (SELECT c_custkey AS id, c_acctbal AS acctbal, CAST(c_nationkey AS DOUBLE) AS nationkey FROM customer),
s AS (SELECT s_suppkey AS id, s_acctbal AS acctbal, CAST(s_nationkey AS DOUBLE) AS nationkey FROM supplier)"""


@query("j01_nn_distance", f"""WITH {_KNN_SQL},
d AS (SELECT s.id, sqrt(power(s.acctbal - r.acctbal, 2) + power(s.nationkey - r.nationkey, 2)) AS d,
        row_number() OVER (PARTITION BY s.id ORDER BY sqrt(power(s.acctbal - r.acctbal, 2) + power(s.nationkey - r.nationkey, 2))) AS rn
      FROM s CROSS JOIN r)
SELECT round(avg(m), 6) AS average_nearest_neighbor_distance FROM (SELECT id, avg(d) AS m FROM d WHERE rn <= 5 GROUP BY id)""")
def j01_nn_distance(spark, sf):
    real, synth = knn_pair(spark, sf)
    return PV.nn_distance(real, synth, KNN_COLS, "id", 5).select(
        r6("average_nearest_neighbor_distance").alias("average_nearest_neighbor_distance"))


@query("j02_overlap_ratio", f"""WITH {_KNN_SQL},
p AS (SELECT 0 AS side, id, acctbal, nationkey, id AS pid FROM r UNION ALL SELECT 1, id, acctbal, nationkey, 1000000000000 + id FROM s),
d AS (SELECT a.pid, a.side, b.pid AS bid, b.side AS bside,
        sqrt(power(a.acctbal - b.acctbal, 2) + power(a.nationkey - b.nationkey, 2)) AS d FROM p a JOIN p b ON a.pid <> b.pid),
m AS (SELECT pid, min(d) AS md FROM d GROUP BY pid),
f AS (SELECT d.pid, d.side, arg_min(bside, bid) AS nside FROM d JOIN m ON d.pid = m.pid AND d.d <= m.md + 1e-12 GROUP BY d.pid, d.side)
SELECT round(count(*) FILTER (WHERE side <> nside) / count(*), 6) AS data_overlap_ratio,
  round(greatest(0, 1 - count(*) FILTER (WHERE side <> nside) / count(*)), 6) AS privacy_score FROM f""")
def j02_overlap_ratio(spark, sf):
    real, synth = knn_pair(spark, sf)
    o = PV.overlap_ratio(real, synth, KNN_COLS, "id", "id")
    return o.select(r6("data_overlap_ratio").alias("data_overlap_ratio"), r6("privacy_score").alias("privacy_score"))


@query("j03_membership_risk")
def j03_membership_risk(spark, sf):
    o = table(spark, sf, "orders")
    train = o.filter(F.col("o_orderkey") % 4 == 0)
    holdout = o.filter(F.col("o_orderkey") % 4 == 2)
    synth = o.filter(F.col("o_orderkey") % 2 == 1).withColumn("o_totalprice", F.col("o_totalprice") * 1.1 + 5)
    cols = ["o_totalprice", "o_custkey"]
    r = PV.membership_risk(train.select(*[F.col(c).cast("double") for c in cols]),
                           holdout.select(*[F.col(c).cast("double") for c in cols]),
                           synth.select(*[F.col(c).cast("double") for c in cols]), cols, n_shadow=3, trees=100, depth=10)
    return r.select(r6("auc_mean").alias("auc_mean"), r6("auc_std").alias("auc_std"), "n_shadow")


_AUC_SQL = """ls AS (SELECT CAST(n_chars AS DOUBLE) AS s, quality AS y FROM labels JOIN documents USING (doc_id)),
rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM ls),
auc AS (SELECT (sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
              / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM rk)"""


@query("j04_roc_auc", f"WITH {_AUC_SQL} SELECT round(auc, 6) AS auc FROM auc")
def j04_roc_auc(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return PV.roc_auc(d, "n_chars", "quality").select(r6("auc").alias("auc"))


_UNIQ_SQL = f"""{_PAIR_O},
rv AS (SELECT DISTINCT v FROM (SELECT o_orderstatus AS v FROM ro UNION ALL SELECT o_orderpriority FROM ro) WHERE v IS NOT NULL),
sv AS (SELECT DISTINCT v FROM (SELECT o_orderstatus AS v FROM so UNION ALL SELECT o_orderpriority FROM so) WHERE v IS NOT NULL),
uq AS (SELECT (SELECT count(*) FROM rv WHERE v IN (SELECT v FROM sv)) / (SELECT count(*) FROM rv) AS u)"""


@query("j05_unique_value_overlap", f"WITH {_UNIQ_SQL} SELECT round(u, 6) AS unique_value_overlap FROM uq")
def j05_unique_value_overlap(spark, sf):
    real, synth = pair_orders(spark, sf)
    return PV.unique_value_overlap(real, synth, CAT_O).select(r6("unique_value_overlap").alias("unique_value_overlap"))


def _copies_pair(spark, sf):
    o = table(spark, sf, "orders")
    real = o.filter(F.col("o_orderkey") % 2 == 0)
    synth = o.filter((F.col("o_orderkey") % 2 == 1) | (F.col("o_orderkey") % 50 == 0))
    return real, synth


_RARE_COLS = ["o_orderstatus", "o_orderpriority", "o_custkey"]


_RARE_SQL = f"""ro2 AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
so2 AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 50 = 0),
rp AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM ro2),
sp AS (SELECT DISTINCT o_orderstatus, o_orderpriority, o_custkey FROM so2),
rare AS (SELECT (SELECT count(*) FROM (SELECT * FROM rp INTERSECT SELECT * FROM sp)) / (SELECT count(*) FROM rp) AS r)"""


@query("j06_rare_pattern_overlap", f"WITH {_RARE_SQL} SELECT round(r, 6) AS rare_pattern_overlap FROM rare")
def j06_rare_pattern_overlap(spark, sf):
    real, synth = _copies_pair(spark, sf)
    return PV.rare_pattern_overlap(real.select(*_RARE_COLS), synth.select(*_RARE_COLS), _RARE_COLS).select(
        r6("rare_pattern_overlap").alias("rare_pattern_overlap"))


@query("j07_exact_copies", """
SELECT o_orderkey FROM orders s WHERE (o_orderkey % 2 = 1 OR o_orderkey % 50 = 0)
  AND EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey % 2 = 0 AND r.o_orderkey IS NOT DISTINCT FROM s.o_orderkey
              AND r.o_custkey IS NOT DISTINCT FROM s.o_custkey AND r.o_orderstatus IS NOT DISTINCT FROM s.o_orderstatus
              AND r.o_totalprice IS NOT DISTINCT FROM s.o_totalprice AND r.o_orderdate IS NOT DISTINCT FROM s.o_orderdate
              AND r.o_orderpriority IS NOT DISTINCT FROM s.o_orderpriority)""")
def j07_exact_copies(spark, sf):
    real, synth = _copies_pair(spark, sf)
    return PV.exact_copies(real, synth, real.columns).select("o_orderkey")


@query("j08_mean_difference_score", f"""WITH {_PAIR_O}
SELECT round(least(1, greatest(0, 1.0 / (1 + (abs((SELECT avg(o_totalprice) FROM ro) - (SELECT avg(o_totalprice) FROM so))
  + abs((SELECT avg(o_custkey) FROM ro) - (SELECT avg(o_custkey) FROM so))) / 2))), 9) AS privacy_score""")
def j08_mean_difference_score(spark, sf):
    real, synth = pair_orders(spark, sf)
    return PV.mean_difference_score(real, synth, NUM_O).select(r6("privacy_score", 9).alias("privacy_score"))


def _runs(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("dataset_size")).select(
        "event_type", F.lit(1.1).alias("noise_scale"), F.lit(64).alias("batch_size"), "dataset_size",
        (F.col("dataset_size") / 64).cast("int").alias("iterations"))


_RUNS_SQL = """runs AS (SELECT event_type, 1.1 AS noise_scale, 64 AS batch_size, count(*) AS dataset_size,
  CAST(floor(count(*) / 64) AS INTEGER) AS iterations FROM events GROUP BY event_type),
b AS (SELECT *, 1.0 / dataset_size AS delta, noise_scale * sqrt(2.0 * iterations * ln(1.25 * dataset_size)) / batch_size AS eps FROM runs)"""


@query("j09_dp_bounds", f"""WITH {_RUNS_SQL}
SELECT event_type, round(eps, 9) AS epsilon, round(delta, 9) AS delta, round(least(eps, 10.0), 9) AS privacy_budget_used FROM b""")
def j09_dp_bounds(spark, sf):
    b = PV.dp_bounds(_runs(spark, sf))
    return b.select("event_type", r6("epsilon", 9).alias("epsilon"), r6("delta", 9).alias("delta"),
                    r6("privacy_budget_used", 9).alias("privacy_budget_used"))


@query("j09_dp_report", f"""WITH {_RUNS_SQL}
SELECT round(avg(eps), 9) AS avg_epsilon, round(max(eps), 9) AS max_epsilon, round(avg(delta), 9) AS avg_delta,
  CASE WHEN avg(eps) < 1 THEN 'Strong differential privacy (e < 1)' WHEN avg(eps) < 3 THEN 'Acceptable differential privacy (e < 3)'
       WHEN avg(eps) < 10 THEN 'Weak differential privacy (e < 10)' ELSE 'Insufficient differential privacy' END AS interpretation FROM b""")
def j09_dp_report(spark, sf):
    r = PV.dp_report(PV.dp_bounds(_runs(spark, sf)))
    return r.select(r6("avg_epsilon", 9).alias("avg_epsilon"), r6("max_epsilon", 9).alias("max_epsilon"),
                    r6("avg_delta", 9).alias("avg_delta"), "interpretation")


@query("j10_privacy_evaluation", f"""WITH {_AUC_SQL}, {_UNIQ_SQL}, {_RARE_SQL}
SELECT round(auc, 6) AS auc, round(r, 6) AS rare_pattern_overlap, round(u, 6) AS unique_value_overlap,
  CASE WHEN auc <= 0.55 AND r < 0.2 THEN 'low' WHEN auc <= 0.65 OR u < 0.3 THEN 'medium' ELSE 'high' END AS risk
FROM auc, rare, uq""")
def j10_privacy_evaluation(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    auc = PV.roc_auc(d, "n_chars", "quality")
    real, synth = pair_orders(spark, sf)
    u = PV.unique_value_overlap(real, synth, CAT_O)
    cr, cs = _copies_pair(spark, sf)
    rare = PV.rare_pattern_overlap(cr.select(*_RARE_COLS), cs.select(*_RARE_COLS), _RARE_COLS)
    k = F.lit(1)
    j = auc.withColumn("_k", k).join(rare.withColumn("_k", k), "_k").join(u.withColumn("_k", k), "_k")
    return j.select(r6("auc").alias("auc"), r6("rare_pattern_overlap").alias("rare_pattern_overlap"),
                    r6("unique_value_overlap").alias("unique_value_overlap"),
                    PV.risk_band(F.col("auc"), F.col("rare_pattern_overlap"), F.col("unique_value_overlap")).alias("risk"))
