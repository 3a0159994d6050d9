"""Real-versus-synthetic fidelity queries.

Fixture (FIXTURES.md §3): one table split by key parity, even keys real,
odd keys synthetic; the synthetic side is shifted (price x 1.1 + 5) and
degraded (one order priority removed).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.functions.normal import phi_inv_sql, phi_sql
from tabvet.operators import fidelity as FI
from tabvet.operators import spread
from tabvet.plans.registry import query, r6
from tabvet.plans.sqlgen import kolmogorov_sql
from tabvet.session import table

NUM_O = ["o_totalprice", "o_custkey"]
CAT_O = ["o_orderstatus", "o_orderpriority"]
NUM_L = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def pair_orders(spark, sf):
    o = table(spark, sf, "orders")
    real = o.filter(F.col("o_orderkey") % 2 == 0)
    low = F.col("o_orderpriority") == "5-LOW"          # a category that the synthetic side never has
    synth = o.filter(F.col("o_orderkey") % 2 == 1).withColumn("o_totalprice", F.col("o_totalprice") * 1.1 + 5) \
        .withColumn("o_orderpriority", F.when(low, "1-URGENT").otherwise(F.col("o_orderpriority")))
    return real, synth


def pair_lineitem(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter(F.col("l_orderkey") % 2 == 0), li.filter(F.col("l_orderkey") % 2 == 1)


_PAIR_O = """ro AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0),
so AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice * 1.1 + 5 AS o_totalprice, o_orderdate,
         CASE WHEN o_orderpriority = '5-LOW' THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority
       FROM orders WHERE o_orderkey % 2 = 1)"""
_PAIR_L = """rl AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 0), sl AS (SELECT * FROM lineitem WHERE l_orderkey % 2 = 1)"""


def _tl(cols, r="ro", s="so", kind="DOUBLE"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {side} AS side, CAST({c} AS {kind}) AS v FROM {t}"
        for c in cols for side, t in ((0, r), (1, s)))


def _sc_sql(cols, kind="DOUBLE", r="ro", s="so"):
    return f"""tl AS ({_tl(cols, r, s, kind)}),
sc AS (SELECT feature, v, count(*) FILTER (WHERE side = 0) AS c_real, count(*) FILTER (WHERE side = 1) AS c_synth
       FROM tl WHERE v IS NOT NULL GROUP BY feature, v),
tot AS (SELECT feature, sum(c_real) AS nr, sum(c_synth) AS ns FROM sc GROUP BY feature)"""


_ALIGN_SQL = f"""{_PAIR_O}, {_sc_sql(CAT_O, 'VARCHAR')},
al AS (SELECT feature, v, c_real / nr AS p_real, c_synth / ns AS p_synth FROM sc JOIN tot USING (feature))"""

_JS_SQL = f"""{_ALIGN_SQL},
js AS (SELECT feature,
  sqrt(greatest(sum(0.5 * CASE WHEN p_real > 0 THEN p_real * ln(p_real / ((p_real + p_synth) / 2)) ELSE 0 END
                  + 0.5 * CASE WHEN p_synth > 0 THEN p_synth * ln(p_synth / ((p_real + p_synth) / 2)) ELSE 0 END), 0)) AS js_distance,
  0.5 * sum(abs(p_real - p_synth)) AS tv_distance FROM al GROUP BY feature)"""


@query("i01_category_alignment", f"""WITH {_ALIGN_SQL}
SELECT feature, v, round(p_real, 6) AS p_real, round(p_synth, 6) AS p_synth FROM al""")
def i01_category_alignment(spark, sf):
    al = FI.aligned_distributions(*pair_orders(spark, sf), CAT_O)
    return al.select("feature", "v", r6("p_real").alias("p_real"), r6("p_synth").alias("p_synth"))


@query("i02_js_distance_categorical", f"WITH {_JS_SQL} SELECT feature, round(js_distance, 6) AS js_distance FROM js")
def i02_js_distance_categorical(spark, sf):
    j = FI.js_tv(FI.aligned_distributions(*pair_orders(spark, sf), CAT_O))
    return j.select("feature", r6("js_distance").alias("js_distance"))


@query("i03_total_variation", f"WITH {_JS_SQL} SELECT feature, round(tv_distance, 6) AS tv_distance FROM js")
def i03_total_variation(spark, sf):
    j = FI.js_tv(FI.aligned_distributions(*pair_orders(spark, sf), CAT_O))
    return j.select("feature", r6("tv_distance").alias("tv_distance"))


@query("i04_category_coverage", f"""WITH {_PAIR_O}, {_sc_sql(CAT_O, 'VARCHAR')}
SELECT feature, round(count(*) FILTER (WHERE c_real > 0 AND c_synth > 0) / greatest(count(*) FILTER (WHERE c_real > 0), 1), 6)
  AS coverage FROM sc GROUP BY feature""")
def i04_category_coverage(spark, sf):
    c = FI.category_coverage(*pair_orders(spark, sf), CAT_O)
    return c.select("feature", r6("coverage").alias("coverage"))


@query("i23_coverage_bands", f"""WITH {_PAIR_O}, {_sc_sql(CAT_O, 'VARCHAR')},
c AS (SELECT feature, count(*) FILTER (WHERE c_real > 0 AND c_synth > 0) / greatest(count(*) FILTER (WHERE c_real > 0), 1) AS x
      FROM sc GROUP BY feature)
SELECT feature, CASE WHEN x >= 0.9 THEN 'Excellent mode coverage' WHEN x >= 0.7 THEN 'Good mode coverage'
  WHEN x >= 0.5 THEN 'Acceptable mode coverage' ELSE 'Poor mode coverage - possible mode collapse' END AS interpretation FROM c""")
def i23_coverage_bands(spark, sf):
    c = FI.category_coverage(*pair_orders(spark, sf), CAT_O)
    return c.select("feature", FI.interpret_coverage(F.col("coverage")).alias("interpretation"))


_NUM_SQL = f"""{_PAIR_O}, {_sc_sql(NUM_O)},
cum AS (SELECT sc.*, nr, ns, sum(c_real) OVER (PARTITION BY feature ORDER BY v) / nr AS Fr,
          sum(c_synth) OVER (PARTITION BY feature ORDER BY v) / ns AS Gs,
          lead(v) OVER (PARTITION BY feature ORDER BY v) AS next_v FROM sc JOIN tot USING (feature))"""

_KS_SQL = f"""{_NUM_SQL},
ks AS (SELECT feature, max(abs(Fr - Gs)) AS d, max(nr) AS nr, max(ns) AS ns FROM cum GROUP BY feature),
ksp AS (SELECT feature, d, nr, ns, {kolmogorov_sql('sqrt(nr * ns / (nr + ns)) * d')} AS p FROM ks)"""


@query("i05_ks_two_sample", f"""WITH {_KS_SQL}
SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value, CAST(nr AS BIGINT) AS n_real,
  CAST(ns AS BIGINT) AS n_synth FROM ksp""")
def i05_ks_two_sample(spark, sf):
    k = FI.ks_two_sample(*pair_orders(spark, sf), NUM_O)
    return k.select("feature", r6("ks_statistic").alias("ks_statistic"), r6("ks_p_value").alias("ks_p_value"),
                    "n_real", "n_synth")


@query("i06_ks_summary", f"""WITH {_KS_SQL}
SELECT round(count(*) FILTER (WHERE p > 0.05) / count(*), 6) AS pass_rate, round(avg(p), 6) AS average_p_value,
  CAST(count(*) AS BIGINT) AS n_features FROM ksp""")
def i06_ks_summary(spark, sf):
    s = FI.ks_summary(FI.ks_two_sample(*pair_orders(spark, sf), NUM_O))
    return s.select(r6("pass_rate").alias("pass_rate"), r6("average_p_value").alias("average_p_value"), "n_features")


_W_SQL = f"""{_NUM_SQL},
w AS (SELECT feature, coalesce(sum(abs(Fr - Gs) * (next_v - v)), 0) AS wasserstein, max(v) - min(v) AS rng FROM cum GROUP BY feature)"""


@query("i07_wasserstein", f"WITH {_W_SQL} SELECT feature, round(wasserstein, 4) AS wasserstein, round(rng, 4) AS range FROM w")
def i07_wasserstein(spark, sf):
    w = FI.wasserstein(*pair_orders(spark, sf), NUM_O)
    return w.select("feature", r6("wasserstein", 4).alias("wasserstein"), r6("range", 4).alias("range"))


@query("i08_wasserstein_normalized", f"""WITH {_W_SQL},
d AS (SELECT CASE WHEN rng > 0 THEN wasserstein / rng ELSE wasserstein END AS d FROM w)
SELECT round(avg(d), 6) AS mean_distance, round(median(d), 6) AS median_distance, round(stddev_pop(d), 6) AS std_distance,
  round(min(d), 6) AS min_distance, round(max(d), 6) AS max_distance FROM d""")
def i08_wasserstein_normalized(spark, sf):
    s = FI.wasserstein_normalized(FI.wasserstein(*pair_orders(spark, sf), NUM_O))
    return s.select(*[r6(c).alias(c) for c in s.columns])


_MOM_SQL = f"""{_PAIR_O}, tl AS ({_tl(NUM_O)}),
m AS (SELECT feature, avg(v) FILTER (WHERE side = 0) AS mr, avg(v) FILTER (WHERE side = 1) AS ms,
        stddev_samp(v) FILTER (WHERE side = 0) AS sr, stddev_samp(v) FILTER (WHERE side = 1) AS ss,
        stddev_pop(v) FILTER (WHERE side = 0) AS spr, stddev_pop(v) FILTER (WHERE side = 1) AS sps FROM tl GROUP BY feature)"""


@query("i09_moment_gap", f"""WITH {_MOM_SQL}
SELECT round(sqrt(sum(power(mr - ms, 2))) + sqrt(sum(power(sr - ss, 2))), 4) AS moment_gap FROM m""")
def i09_moment_gap(spark, sf):
    return FI.moment_gap(*pair_orders(spark, sf), NUM_O).select(r6("moment_gap", 4).alias("moment_gap"))


@query("i10_relative_moments", f"""WITH {_MOM_SQL}
SELECT feature, round(abs(mr - ms) / (abs(mr) + 1e-8), 6) AS mean_difference, round(abs(sr - ss) / (sr + 1e-8), 6) AS std_difference,
  round(mr, 4) AS real_mean, round(ms, 4) AS synth_mean FROM m""")
def i10_relative_moments(spark, sf):
    r = FI.relative_moments(*pair_orders(spark, sf), NUM_O)
    return r.select("feature", r6("mean_difference").alias("mean_difference"), r6("std_difference").alias("std_difference"),
                    r6("real_mean", 4).alias("real_mean"), r6("synth_mean", 4).alias("synth_mean"))


@query("i39_batch_consistency", f"""WITH {_MOM_SQL}
SELECT feature, round(power(mr - ms, 2) + power(spr - sps, 2), 2) AS loss FROM m""")
def i39_batch_consistency(spark, sf):
    return FI.batch_consistency(*pair_orders(spark, sf), NUM_O).select("feature", r6("loss", 2).alias("loss"))


def _hist_sql(n_bins, smoothing):
    return f"""{_PAIR_O}, tl AS ({_tl(NUM_O)}),
st0 AS (SELECT feature, min(v) AS lo, max(v) AS hi0 FROM tl GROUP BY feature),
st AS (SELECT feature, lo, CASE WHEN hi0 - lo < 1e-10 THEN lo + 1 ELSE hi0 END AS hi FROM st0),
ns AS (SELECT feature, count(*) FILTER (WHERE side = 0) AS nr, count(*) FILTER (WHERE side = 1) AS ns FROM tl GROUP BY feature),
b AS (SELECT tl.feature, side, CAST(least(floor((v - lo) / ((hi - lo) / {n_bins})), {n_bins - 1}) AS INTEGER) AS bin
      FROM tl JOIN st USING (feature)),
c AS (SELECT feature, bin, count(*) FILTER (WHERE side = 0) AS cr, count(*) FILTER (WHERE side = 1) AS cs FROM b GROUP BY feature, bin),
g AS (SELECT feature, lo, hi, CAST(r.range AS INTEGER) AS bin FROM st, range({n_bins}) r),
h AS (SELECT g.feature, coalesce(cr, 0) / (nr * (hi - lo) / {n_bins}) + {smoothing} AS p,
             coalesce(cs, 0) / (ns * (hi - lo) / {n_bins}) + {smoothing} AS q
      FROM g LEFT JOIN c USING (feature, bin) JOIN ns USING (feature)),
hn AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM h),
js AS (SELECT feature, sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
                                   + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0)) AS d FROM hn GROUP BY feature)"""


@query("i11_histogram_js_49", f"""WITH {_hist_sql(49, 0.0)}
SELECT feature, round(d, 6) AS divergence, round(1 - d, 6) AS similarity, d < 0.1 AS passed FROM js""")
def i11_histogram_js_49(spark, sf):
    h = FI.histogram_js(*pair_orders(spark, sf), NUM_O, n_bins=49)
    return h.select("feature", r6("divergence").alias("divergence"), r6("similarity").alias("similarity"), "passed")


@query("i12_histogram_js_100", f"""WITH {_hist_sql(100, 1e-10)}
SELECT feature, round(d, 6) AS divergence FROM js""")
def i12_histogram_js_100(spark, sf):
    h = FI.histogram_js(*pair_orders(spark, sf), NUM_O, n_bins=100, smoothing=1e-10)
    return h.select("feature", r6("divergence").alias("divergence"))


@query("i13_kde_js", f"""WITH {_PAIR_O}, tl AS ({_tl(NUM_O)}),
st AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM tl GROUP BY feature),
ss AS (SELECT feature, side, count(v) AS n, stddev_samp(v) AS sd FROM tl GROUP BY feature, side),
hb AS (SELECT feature, side, least(floor((v - lo) / ((hi - lo) / 2048)), 2047) AS b, count(*) AS c FROM tl JOIN st USING (feature)
       WHERE v IS NOT NULL GROUP BY feature, side, b),
de AS (SELECT feature, side, gi, sum(c * exp(-0.5 * power((lo + gi * (hi - lo) / 99 - (lo + (b + 0.5) * ((hi - lo) / 2048)))
         / (sd * power(n, -0.2)), 2))) AS d FROM hb JOIN st USING (feature) JOIN ss USING (feature, side), range(100) AS t(gi)
       GROUP BY feature, side, gi),
w AS (SELECT feature, gi, sum(d) FILTER (side = 0) AS p, sum(d) FILTER (side = 1) AS q FROM de GROUP BY feature, gi),
hn AS (SELECT feature, p / sum(p) OVER (PARTITION BY feature) AS p, q / sum(q) OVER (PARTITION BY feature) AS q FROM w),
js AS (SELECT feature, sqrt(greatest(sum(0.5 * CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END
         + 0.5 * CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0)) AS d FROM hn GROUP BY feature)
SELECT feature, round(d, 6) AS divergence FROM js""")
def i13_kde_js(spark, sf):
    k = FI.kde_js(*pair_orders(spark, sf), NUM_O)
    return k.select("feature", r6("divergence").alias("divergence"))


def _chi_p(x, dof_half):
    terms = " + ".join(f"power(({x}) / 2.0, {i}) / {float(__import__('math').factorial(i))}" for i in range(dof_half))
    return f"exp(-({x}) / 2.0) * ({terms})"


@query("i14_chi_square_proportions", f"""WITH {_ALIGN_SQL},
n AS (SELECT feature, ns FROM tot),
st AS (SELECT feature, CASE WHEN max(CASE WHEN p_real = 0 THEN 1 ELSE 0 END) = 1 THEN NULL ELSE sum(power(p_synth - p_real, 2) / p_real) END AS s,
         CASE WHEN max(CASE WHEN p_real = 0 THEN 1 ELSE 0 END) = 1 THEN NULL
              ELSE sum(power(p_synth * ns - p_real * ns, 2) / (p_real * ns)) END AS cs, count(*) AS k
       FROM al JOIN n USING (feature) GROUP BY feature)
SELECT feature, round(s, 6) AS statistic,
  round(CASE WHEN k = 3 THEN {_chi_p('s', 1)} WHEN k = 5 THEN {_chi_p('s', 2)} END, 6) AS pvalue,
  CASE WHEN k = 3 THEN {_chi_p('s', 1)} WHEN k = 5 THEN {_chi_p('s', 2)} END > 0.05 AS passed,
  round(cs, 4) AS count_statistic,
  round(CASE WHEN k = 3 THEN {_chi_p('cs', 1)} WHEN k = 5 THEN {_chi_p('cs', 2)} END, 6) AS count_pvalue FROM st""")
def i14_chi_square_proportions(spark, sf):
    c = FI.chi_square_proportions(*pair_orders(spark, sf), CAT_O)
    return c.select("feature", r6("statistic").alias("statistic"), r6("pvalue").alias("pvalue"), "passed",
                    r6("count_statistic", 4).alias("count_statistic"), r6("count_pvalue").alias("count_pvalue"))


def _corr_long_sql(src, cols, alias, method="pearson"):
    from itertools import combinations
    parts = []
    if method == "spearman":
        rk = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols)
        src_q = f"(SELECT {rk} FROM {src})"
        val = lambda c: f"r_{c}"
    else:
        src_q, val = src, (lambda c: c)
    for a, b in combinations(cols, 2):
        # rounded to 12 digits: two parallel evaluations of the same corr()
        # may differ in the last bits, and the matrix is exactly symmetric
        parts.append(f"SELECT '{a}' AS col1, '{b}' AS col2, round(corr({val(a)}, {val(b)}), 12) AS {alias} FROM {src_q}")
        parts.append(f"SELECT '{b}' AS col1, '{a}' AS col2, round(corr({val(a)}, {val(b)}), 12) AS {alias} FROM {src_q}")
    for c in cols:
        parts.append(f"SELECT '{c}' AS col1, '{c}' AS col2, 1.0 AS {alias}")
    return " UNION ALL ".join(parts)


@query("i15_pearson_matrix", f"SELECT col1, col2, round(c, 6) AS corr FROM ({_corr_long_sql('lineitem', NUM_L, 'c')})")
def i15_pearson_matrix(spark, sf):
    from tabvet.operators.relations import correlation_matrix
    return correlation_matrix(table(spark, sf, "lineitem"), NUM_L).select("col1", "col2", r6("corr").alias("corr"))


@query("i16_spearman_matrix", f"SELECT col1, col2, round(c, 6) AS corr FROM ({_corr_long_sql('lineitem', NUM_L, 'c', 'spearman')})")
def i16_spearman_matrix(spark, sf):
    from tabvet.operators.relations import correlation_matrix
    return correlation_matrix(table(spark, sf, "lineitem"), NUM_L, "spearman").select("col1", "col2", r6("corr").alias("corr"))


@query("i17_kendall_tau_b", """
WITH cells AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_linenumber AS DOUBLE) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2),
cd AS (SELECT sum(CASE WHEN a.y < b.y THEN a.c * b.c ELSE 0 END) AS cc, sum(CASE WHEN a.y > b.y THEN a.c * b.c ELSE 0 END) AS dd
       FROM cells a JOIN cells b ON a.x < b.x),
n AS (SELECT sum(c) AS n FROM cells),
t1 AS (SELECT sum(t * (t - 1) / 2) AS n1 FROM (SELECT sum(c) AS t FROM cells GROUP BY x)),
t2 AS (SELECT sum(t * (t - 1) / 2) AS n2 FROM (SELECT sum(c) AS t FROM cells GROUP BY y))
SELECT 'l_quantity' AS col1, 'l_linenumber' AS col2,
  round((cc - dd) / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS kendall_tau_b FROM cd, n, t1, t2""")
def i17_kendall_tau_b(spark, sf):
    k = FI.kendall_tau_b(table(spark, sf, "lineitem"), "l_quantity", "l_linenumber")
    return k.select("col1", "col2", r6("kendall_tau_b").alias("kendall_tau_b"))


def _tau_sql(a, b):
    return f"""SELECT '{a}' AS col1, '{b}' AS col2, round((cc - dd) / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 6) AS kendall_tau_b
FROM (WITH cells AS (SELECT CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, count(*) AS c FROM lineitem GROUP BY 1, 2)
  SELECT (SELECT sum(CASE WHEN p.y < q.y THEN p.c * q.c ELSE 0 END) FROM cells p JOIN cells q ON p.x < q.x) AS cc,
    (SELECT sum(CASE WHEN p.y > q.y THEN p.c * q.c ELSE 0 END) FROM cells p JOIN cells q ON p.x < q.x) AS dd,
    (SELECT sum(c) FROM cells) AS n, (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM cells GROUP BY x)) AS n1,
    (SELECT sum(t * (t - 1) / 2) FROM (SELECT sum(c) AS t FROM cells GROUP BY y)) AS n2)"""


_TAU_COLS = ["l_quantity", "l_linenumber", "l_discount", "l_tax"]


@query("i17_kendall_matrix", "\nUNION ALL ".join(
    _tau_sql(a, b) for i, a in enumerate(_TAU_COLS) for b in _TAU_COLS[i + 1:]))
def i17_kendall_matrix(spark, sf):
    k = FI.kendall_matrix(table(spark, sf, "lineitem"), _TAU_COLS)
    return k.select("col1", "col2", r6("kendall_tau_b").alias("kendall_tau_b"))


_MSIM_SQL = f"""{_PAIR_L},
a AS ({_corr_long_sql('rl', NUM_L, 'r_real')}), b AS ({_corr_long_sql('sl', NUM_L, 'r_synth')}),
v AS (SELECT a.col1, a.col2, r_real, r_synth FROM a JOIN b USING (col1, col2)),
r AS (SELECT *, rank() OVER (ORDER BY r_real) + (count(*) OVER (PARTITION BY r_real) - 1) / 2.0 AS ar,
             rank() OVER (ORDER BY r_synth) + (count(*) OVER (PARTITION BY r_synth) - 1) / 2.0 AS asy,
             row_number() OVER (ORDER BY r_real, col1, col2) AS o1, row_number() OVER (ORDER BY r_synth, col1, col2) AS o2 FROM v),
m AS (SELECT corr(r_real, r_synth) AS pearson_correlation, corr(ar, asy) AS spearman_correlation,
        avg(abs(r_real - r_synth)) AS mean_absolute_difference, sqrt(avg(power(r_real - r_synth, 2))) AS rms_difference,
        max(abs(r_real - r_synth)) AS max_absolute_difference, corr(o1, o2) AS rank_preservation,
        1 - sqrt(sum(power(r_real - r_synth, 2))) / sqrt(2.0 * count(*)) AS frobenius_similarity FROM r)"""


def _msim(spark, sf):
    return FI.matrix_similarity(FI.paired_matrices(*pair_lineitem(spark, sf), NUM_L))


@query("i18_matrix_similarity", f"""WITH {_MSIM_SQL}
SELECT round(pearson_correlation, 6) AS pearson_correlation, round(spearman_correlation, 6) AS spearman_correlation,
  round(mean_absolute_difference, 6) AS mean_absolute_difference, round(rank_preservation, 6) AS rank_preservation FROM m""")
def i18_matrix_similarity(spark, sf):
    m = _msim(spark, sf)
    return m.select(*[r6(c).alias(c) for c in ("pearson_correlation", "spearman_correlation",
                                                "mean_absolute_difference", "rank_preservation")])


@query("i19_correlation_preservation", f"""WITH {_MSIM_SQL}
SELECT round(pearson_correlation, 6) AS preservation_score, round(rms_difference, 6) AS rms_difference,
  round(max_absolute_difference, 6) AS max_absolute_difference FROM m""")
def i19_correlation_preservation(spark, sf):
    m = _msim(spark, sf)
    return m.select(r6("pearson_correlation").alias("preservation_score"), r6("rms_difference").alias("rms_difference"),
                    r6("max_absolute_difference").alias("max_absolute_difference"))


@query("i20_frobenius_similarity", f"""WITH {_MSIM_SQL}
SELECT round(frobenius_similarity, 6) AS correlation_similarity, frobenius_similarity > 0.8 AS passed FROM m""")
def i20_frobenius_similarity(spark, sf):
    m = _msim(spark, sf)
    return m.select(r6("frobenius_similarity").alias("correlation_similarity"),
                    (F.col("frobenius_similarity") > 0.8).alias("passed"))


@query("i21_gmm_mode_coverage")
def i21_gmm_mode_coverage(spark, sf):
    real, synth = pair_lineitem(spark, sf)
    g = FI.gmm_coverage(real, synth, ["l_quantity", "l_extendedprice"], k_range=(2, 10))
    return g.select("k", "m", r6("real_share").alias("real_share"), r6("synth_share").alias("synth_share"),
                    r6("coverage").alias("coverage"))


@query("i22_kmeans_mode_coverage")
def i22_kmeans_mode_coverage(spark, sf):
    real, synth = pair_lineitem(spark, sf)
    return FI.kmeans_coverage(real, synth, NUM_L)


@query("i24_diversity", f"""
WITH p AS (SELECT o_orderkey AS k, CAST(o_totalprice AS DOUBLE) AS x, CAST(o_custkey AS DOUBLE) AS y, r,
                  floor({hu_sql(42, "r", "o_orderkey")} * greatest(n // 2, 1)) AS b
           FROM orders, range(4) AS s(r), (SELECT count(*) AS n FROM orders)),
m AS (SELECT avg(d) AS mean, stddev_samp(d) / sqrt(count(*)) AS err, count(*) AS pairs
      FROM (SELECT sqrt(power(p.x - q.x, 2) + power(p.y - q.y, 2)) AS d
            FROM p JOIN p AS q ON p.r = q.r AND p.b = q.b AND p.k < q.k)),
l AS (SELECT sqrt(max(power(CAST(u.o_totalprice - v.o_totalprice AS DOUBLE), 2)
                      + power(CAST(u.o_custkey - v.o_custkey AS DOUBLE), 2))) AS longest FROM orders AS u, orders AS v)
SELECT round(mean, 4) AS mean_distance, round(err, 4) AS mean_error, pairs, round(longest, 4) AS max_distance,
       round(mean / longest, 6) AS diversity_score FROM m, l""")
def i24_diversity(spark, sf):
    d = spread.diversity(table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], ["o_orderkey"])
    return d.select(*[r6(c, 4).alias(c) for c in ("mean_distance", "mean_error")], "pairs",
                    r6("max_distance", 4).alias("max_distance"), r6("diversity_score").alias("diversity_score"))


@query("i25_cosine_similarity", """
WITH u AS (SELECT CASE WHEN nrm > 0 THEN l_quantity / nrm ELSE 0 END AS a, CASE WHEN nrm > 0 THEN l_extendedprice / nrm ELSE 0 END AS b,
                  CASE WHEN nrm > 0 THEN l_discount / nrm ELSE 0 END AS c, CASE WHEN nrm > 0 THEN l_tax / nrm ELSE 0 END AS d
           FROM (SELECT *, sqrt(l_quantity * l_quantity + l_extendedprice * l_extendedprice + l_discount * l_discount + l_tax * l_tax) AS nrm FROM lineitem)),
s AS (SELECT sum(a) AS sa, sum(b) AS sb, sum(c) AS sc, sum(d) AS sd, sum(a * a + b * b + c * c + d * d) AS ss, count(*) AS n FROM u)
SELECT round((sa * sa + sb * sb + sc * sc + sd * sd - ss) / (n * (n - 1.0)), 6) AS similarity_score FROM s""")
def i25_cosine_similarity(spark, sf):
    return FI.mean_cosine_similarity(table(spark, sf, "lineitem"), NUM_L).select(
        r6("similarity_score").alias("similarity_score"))


@query("i26_joint_entropy", """
WITH m AS (SELECT min(l_quantity) AS lq, max(l_quantity) AS hq, min(l_discount) AS ld, max(l_discount) AS hd FROM lineitem),
b AS (SELECT least(floor((l_quantity - lq) / ((hq - lq) / 20)), 19) AS bq, least(floor((l_discount - ld) / ((hd - ld) / 20)), 19) AS bd
      FROM lineitem, m),
c AS (SELECT count(*) AS c FROM b GROUP BY bq, bd),
p AS (SELECT c / sum(c) OVER () AS p FROM c)
SELECT round(-sum(p * ln(p + 1e-10)) / (2 * ln(20)), 6) AS normalized_entropy FROM p""")
def i26_joint_entropy(spark, sf):
    return FI.joint_entropy(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"]).select(
        r6("normalized_entropy").alias("normalized_entropy"))


@query("i27_collapse_verdict")
def i27_collapse_verdict(spark, sf):
    o = table(spark, sf, "orders")
    real, synth = pair_orders(spark, sf)
    d = spread.diversity(o, ["o_totalprice", "o_custkey"], ["o_orderkey"]).select("diversity_score")
    s = FI.mean_cosine_similarity(o, ["o_totalprice", "o_custkey"])
    c = FI.kmeans_coverage(real, synth, NUM_O).select("mode_coverage")
    k = F.lit(1)
    j = d.withColumn("_k", k).join(s.withColumn("_k", k), "_k").join(c.withColumn("_k", k), "_k")
    return j.select(r6("diversity_score").alias("diversity_score"), r6("similarity_score").alias("similarity_score"),
                    r6("mode_coverage").alias("mode_coverage"),
                    FI.collapse_verdict(F.col("diversity_score"), F.col("similarity_score"),
                                        F.col("mode_coverage")).alias("mode_collapse"))


# --- I28-I32: original versus transformed --------------------------------------

def _orig_trans(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderpriority", "o_totalprice",
                    F.log(F.col("o_totalprice") + 1).alias("o_totalprice_t"))


_OT_SQL = """ot AS (SELECT o_orderkey, o_orderpriority, o_totalprice, ln(o_totalprice + 1) AS o_totalprice_t FROM orders)"""


def _mi_sql(x, y, src):
    return f"""mm AS (SELECT min({x}) AS lx, max({x}) AS hx, min({y}) AS ly, max({y}) AS hy FROM {src}),
bins AS (SELECT least(floor(({x} - lx) / CASE WHEN hx > lx THEN (hx - lx) / 20 ELSE 1 END), 19) AS bxx,
                least(floor(({y} - ly) / CASE WHEN hy > ly THEN (hy - ly) / 20 ELSE 1 END), 19) AS byy FROM {src}, mm),
cells AS (SELECT bxx, byy, count(*) AS c FROM bins GROUP BY bxx, byy),
n AS (SELECT sum(c) AS n FROM cells),
px AS (SELECT bxx, sum(c) AS cx FROM cells GROUP BY bxx), py AS (SELECT byy, sum(c) AS cy FROM cells GROUP BY byy),
mi AS (SELECT sum(c / n * ln((c / n) / ((cx / n) * (cy / n) + 1e-12))) AS mutual_information
       FROM cells JOIN px USING (bxx) JOIN py USING (byy), n)"""


@query("i29_binned_mutual_information", f"""WITH {_OT_SQL}, {_mi_sql('o_totalprice', 'o_totalprice_t', 'ot')}
SELECT round(mutual_information, 6) AS mutual_information FROM mi""")
def i29_binned_mutual_information(spark, sf):
    return FI.binned_mi(_orig_trans(spark, sf), "o_totalprice", "o_totalprice_t").select(
        r6("mutual_information").alias("mutual_information"))


@query("i28_column_preservation", f"""WITH {_OT_SQL}, {_mi_sql('o_totalprice', 'o_totalprice_t', 'ot')},
rk AS (SELECT rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS ro,
              rank() OVER (ORDER BY o_totalprice_t) + (count(*) OVER (PARTITION BY o_totalprice_t) - 1) / 2.0 AS rt FROM ot),
sp AS (SELECT corr(ro, rt) AS s FROM rk),
mo AS (SELECT abs(avg(o_totalprice) - avg(o_totalprice_t)) / (abs(avg(o_totalprice)) + 1e-12) AS mp,
              abs(stddev_pop(o_totalprice) - stddev_pop(o_totalprice_t)) / (stddev_pop(o_totalprice) + 1e-12) AS spr FROM ot),
tl AS (SELECT 0 AS side, o_totalprice AS v FROM ot UNION ALL SELECT 1, o_totalprice_t FROM ot),
sc AS (SELECT v, count(*) FILTER (WHERE side = 0) AS cr, count(*) FILTER (WHERE side = 1) AS cs FROM tl GROUP BY v),
cum AS (SELECT sum(cr) OVER (ORDER BY v) / (SELECT count(*) FROM ot) AS f, sum(cs) OVER (ORDER BY v) / (SELECT count(*) FROM ot) AS g FROM sc),
ks AS (SELECT max(abs(f - g)) AS d, (SELECT count(*) FROM ot) AS n FROM cum)
SELECT round(s, 6) AS spearman_correlation, round(mp, 6) AS mean_preservation, round(spr, 6) AS std_preservation,
  round(d, 6) AS ks_statistic, round({kolmogorov_sql('sqrt(n * n / (2.0 * n)) * d')}, 6) AS ks_p_value,
  round(mutual_information, 6) AS mutual_information FROM sp, mo, ks, mi""")
def i28_column_preservation(spark, sf):
    c = FI.column_preservation(_orig_trans(spark, sf), "o_totalprice", "o_totalprice_t")
    return c.select(*[r6(x).alias(x) for x in ("spearman_correlation", "mean_preservation", "std_preservation",
                                               "ks_statistic", "ks_p_value", "mutual_information")])


def _li_trans(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*NUM_L), li.select(*[F.log(F.col(c) + 1).alias(c) for c in NUM_L])


_LT_SQL = f"""lt AS (SELECT {', '.join(f'ln({c} + 1) AS {c}' for c in NUM_L)} FROM lineitem),
a AS ({_corr_long_sql('lineitem', NUM_L, 'r_real')}), b AS ({_corr_long_sql('lt', NUM_L, 'r_synth')}),
v AS (SELECT a.col1, a.col2, r_real, r_synth FROM a JOIN b USING (col1, col2)),
rel AS (SELECT avg(abs(r_real - r_synth)) AS mean_difference, max(abs(r_real - r_synth)) AS max_difference,
          corr(r_real, r_synth) AS correlation_similarity FROM v)"""


@query("i30_relationship_preservation", f"""WITH {_LT_SQL}
SELECT round(mean_difference, 6) AS mean_difference, round(max_difference, 6) AS max_difference,
  round(correlation_similarity, 6) AS correlation_similarity FROM rel""")
def i30_relationship_preservation(spark, sf):
    m = FI.matrix_similarity(FI.paired_matrices(*_li_trans(spark, sf), NUM_L))
    return m.select(r6("mean_absolute_difference").alias("mean_difference"),
                    r6("max_absolute_difference").alias("max_difference"),
                    r6("pearson_correlation").alias("correlation_similarity"))


@query("i31_transformation_score", f"""WITH {_LT_SQL}
SELECT round((least(greatest(correlation_similarity, 0), 1) + 0.5) / 2, 6) AS strict_score,
  round(least(greatest(correlation_similarity, 0), 1), 6) AS score FROM rel""")
def i31_transformation_score(spark, sf):
    m = FI.matrix_similarity(FI.paired_matrices(*_li_trans(spark, sf), NUM_L))
    sim = F.col("pearson_correlation")
    # strict: the reference's structural score (similarity and a constant 0.5
    # for its empty hierarchy check); default: the available components only
    strict = FI.transformation_score(sim, None, None, None, F.lit(False))
    score = FI.transformation_score(sim, None, None, None, None)
    return m.select(r6(strict).alias("strict_score"), r6(score).alias("score"))


@query("i32_hierarchy_preservation", f"""WITH {_OT_SQL},
g AS (SELECT o_orderpriority, avg(o_totalprice) AS a, avg(o_totalprice_t) AS b FROM ot GROUP BY o_orderpriority),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM g)
SELECT round(corr(ra, rb), 6) AS group_mean_spearman, CAST(count(*) AS BIGINT) AS n_groups, corr(ra, rb) > 0.9 AS preserved FROM r""")
def i32_hierarchy_preservation(spark, sf):
    ot = _orig_trans(spark, sf)
    a = ot.select("o_orderpriority", "o_totalprice")
    b = ot.select("o_orderpriority", F.col("o_totalprice_t").alias("o_totalprice"))
    h = FI.hierarchy_preservation(a, b, "o_orderpriority", "o_totalprice", "o_orderkey")
    return h.select(r6("group_mean_spearman").alias("group_mean_spearman"), "n_groups", "preserved")


# --- I33-I37: scores ---------------------------------------------------------------
# Each component is an independent scalar subquery with its own WITH clause.

_Q_JS = f"(WITH {_JS_SQL} SELECT avg(js_distance) FROM js)"
_Q_MPEARSON = f"(WITH {_MSIM_SQL} SELECT pearson_correlation FROM m)"
_Q_MFROB = f"(WITH {_MSIM_SQL} SELECT frobenius_similarity FROM m)"
_Q_KSRATE = f"(WITH {_KS_SQL} SELECT count(*) FILTER (WHERE p > 0.05) / count(*) FROM ksp)"
_Q_H49 = f"(WITH {_hist_sql(49, 0.0)} SELECT avg(1 - d) FROM js)"
_Q_H100 = f"(WITH {_hist_sql(100, 1e-10)} SELECT avg(d) FROM js)"
_Q_WN = f"(WITH {_W_SQL} SELECT avg(CASE WHEN rng > 0 THEN wasserstein / rng ELSE wasserstein END) FROM w)"


@query("i33_quality_score_a", f"""
SELECT round((0.4 * greatest(0, 1 - 10 * {_Q_JS}) + 0.3 * ({_Q_MPEARSON} + 1) / 2) / 0.7, 6) AS quality_score""")
def i33_quality_score_a(spark, sf):
    js = FI.js_tv(FI.aligned_distributions(*pair_orders(spark, sf), CAT_O)).agg(F.avg("js_distance").alias("js"))
    m = _msim(spark, sf).select(F.col("pearson_correlation").alias("corr"))
    k = F.lit(1)
    j = js.withColumn("_k", k).join(m.withColumn("_k", k), "_k")
    # privacy is scored in the privacy family; absent here, weights re-normalise
    return j.select(r6(FI.quality_score_a(F.col("js"), F.col("corr"), F.lit(None).cast("double"))).alias("quality_score"))


_SCORE_B = f"(({_Q_KSRATE} + {_Q_H49} + {_Q_MFROB}) / 3.0)"


@query("i34_quality_score_b", f"SELECT round({_SCORE_B}, 6) AS quality_score")
def i34_quality_score_b(spark, sf):
    return _score_b(spark, sf).select(r6("s").alias("quality_score"))


def _score_b(spark, sf):
    real, synth = pair_orders(spark, sf)
    ks = FI.ks_summary(FI.ks_two_sample(real, synth, NUM_O)).select(F.col("pass_rate").alias("a"))
    js = FI.histogram_js(real, synth, NUM_O, 49).agg(F.avg("similarity").alias("b"))
    cs = _msim(spark, sf).select(F.col("frobenius_similarity").alias("c"))
    k = F.lit(1)
    j = ks.withColumn("_k", k).join(js.withColumn("_k", k), "_k").join(cs.withColumn("_k", k), "_k")
    return j.select(((F.col("a") + F.col("b") + F.col("c")) / 3.0).alias("s"))


@query("i36_quality_verdict", f"""
SELECT CASE WHEN s >= 0.9 THEN 'EXCELLENT' WHEN s >= 0.7 THEN 'GOOD' WHEN s >= 0.5 THEN 'FAIR' ELSE 'POOR' END AS verdict
FROM (SELECT {_SCORE_B} AS s)""")
def i36_quality_verdict(spark, sf):
    return _score_b(spark, sf).select(FI.verdict(F.col("s")).alias("verdict"))


@query("i35_quality_score_c", f"""
SELECT round((0.3 / (1 + {_Q_WN}) + 0.25 / (1 + {_Q_H100}) + 0.25 * {_Q_MPEARSON}) / 0.8, 6) AS quality_score""")
def i35_quality_score_c(spark, sf):
    real, synth = pair_orders(spark, sf)
    w = FI.wasserstein_normalized(FI.wasserstein(real, synth, NUM_O)).select(F.col("mean_distance").alias("w"))
    js = FI.histogram_js(real, synth, NUM_O, 100, 1e-10).agg(F.avg("divergence").alias("js"))
    c = _msim(spark, sf).select(F.col("pearson_correlation").alias("corr"))
    k = F.lit(1)
    j = w.withColumn("_k", k).join(js.withColumn("_k", k), "_k").join(c.withColumn("_k", k), "_k")
    # mode coverage is left out here; weights re-normalise to the metrics present
    return j.select(r6(FI.quality_score_c(F.col("w"), F.col("js"), F.col("corr"), F.lit(None).cast("double")))
                    .alias("quality_score"))


_UNKNOWN = "'unknown test: no_such_test'"


@query("i37_selectable_audit", f"""
SELECT * FROM (WITH {_KS_SQL} SELECT 'ks' AS test, feature, 'ks_statistic' AS metric, round(d, 6) AS value,
                CAST(NULL AS VARCHAR) AS error FROM ksp)
UNION ALL SELECT * FROM (WITH {_JS_SQL} SELECT 'js_categorical', feature, 'js_distance', round(js_distance, 6),
                CAST(NULL AS VARCHAR) FROM js)
UNION ALL SELECT 'no_such_test', NULL, NULL, NULL, {_UNKNOWN}""")
def i37_selectable_audit(spark, sf):
    real, synth = pair_orders(spark, sf)
    a = FI.audit(real, synth, NUM_O, CAT_O, ["ks", "js_categorical", "no_such_test"])
    return a.select("test", "feature", "metric", r6("value").alias("value"), "error")


@query("i38_metric_registry")
def i38_metric_registry(spark, sf):
    real, synth = pair_orders(spark, sf)
    return FI.audit(real, synth, NUM_O, CAT_O).select("test", "feature", "metric", r6("value").alias("value"), "error")


# --- I40: distribution tables ------------------------------------------------------

@query("i40_density_histogram", """
WITH st AS (SELECT min(o_totalprice) AS mn, max(o_totalprice) AS mx, count(*) AS n FROM orders),
b AS (SELECT CAST(least(floor((o_totalprice - mn) / ((mx - mn) / 50)), 49) AS INTEGER) AS bin FROM orders, st),
c AS (SELECT bin, count(*) AS c FROM b GROUP BY bin),
g AS (SELECT CAST(range AS INTEGER) AS bin, mn, mx, n FROM range(50), st)
SELECT bin, round(mn + bin * (mx - mn) / 50, 4) AS lo, round(mn + (bin + 1) * (mx - mn) / 50, 4) AS hi,
  CAST(coalesce(c, 0) AS BIGINT) AS count, round(coalesce(c, 0) / (n * (mx - mn) / 50), 12) AS density FROM g LEFT JOIN c USING (bin)""")
def i40_density_histogram(spark, sf):
    h = FI.density_histogram(table(spark, sf, "orders"), "o_totalprice")
    return h.select("bin", r6("lo", 4).alias("lo"), r6("hi", 4).alias("hi"), "count", r6("density", 12).alias("density"))


@query("i40_box_stats", """
WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.5) AS median,
                  quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)
SELECT round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
  round(min(CASE WHEN o_totalprice >= q1 - 1.5 * (q3 - q1) THEN o_totalprice END), 4) AS whisker_low,
  round(max(CASE WHEN o_totalprice <= q3 + 1.5 * (q3 - q1) THEN o_totalprice END), 4) AS whisker_high,
  CAST(count(*) FILTER (WHERE o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outliers,
  round(q3 - q1, 4) AS iqr FROM orders, q GROUP BY q1, median, q3""")
def i40_box_stats(spark, sf):
    b = FI.box_stats(table(spark, sf, "orders"), "o_totalprice")
    return b.select(*[r6(c, 4).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers",
                    r6("iqr", 4).alias("iqr"))


@query("i40_qq_normal", f"""
WITH s AS (SELECT row_number() OVER (ORDER BY o_totalprice) AS i, o_totalprice AS v, count(*) OVER () AS n FROM orders),
m AS (SELECT i, v, CASE WHEN i = n THEN power(0.5, 1.0 / n) WHEN i = 1 THEN 1 - power(0.5, 1.0 / n)
                        ELSE (i - 0.3175) / (n + 0.365) END AS p FROM s)
SELECT i, round({phi_inv_sql('p')}, 6) AS theoretical, round(v, 4) AS sample FROM m""")
def i40_qq_normal(spark, sf):
    q = FI.qq_normal(table(spark, sf, "orders"), "o_totalprice")
    return q.select("i", r6("theoretical").alias("theoretical"), r6("sample", 4).alias("sample"))


@query("i40_ecdf", """
SELECT o_totalprice AS value, round(count(*) OVER (ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  / count(*) OVER (), 9) AS ecdf FROM (SELECT DISTINCT o_totalprice FROM orders) d""".replace(
    "FROM (SELECT DISTINCT o_totalprice FROM orders) d", "FROM orders QUALIFY row_number() OVER (PARTITION BY o_totalprice) = 1"))
def i40_ecdf(spark, sf):
    e = FI.ecdf(table(spark, sf, "orders"), "o_totalprice")
    return e.select("value", r6("ecdf", 9).alias("ecdf"))
