"""Column-profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.functions.normal import phi_inv_sql, phi_sql
from tabvet.operators import powerlaw as PL
from tabvet.operators import profile as P
from tabvet.operators import tails as T
from tabvet.plans.registry import query, r6
from tabvet.plans.sqlgen import counts_sql, kolmogorov_sql, long_sql
from tabvet.session import table
from tabvet.sources.fixtures import CUSTOMER_NULLS_SQL, customer_nulls

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CAT_ORDERS = ["o_orderpriority", "o_orderstatus"]
CAT_CUST = ["c_mktsegment", "c_name"]


def _li(spark, sf):
    return table(spark, sf, "lineitem")


def _round(df, cols):
    return df.select(*[r6(c).alias(c) if c in cols else F.col(c) for c in df.columns])


_MOMENTS_SQL = f"""
WITH long AS ({long_sql('lineitem', NUM)}),
m AS (SELECT feature, avg(v) AS mu FROM long GROUP BY feature)
SELECT l.feature, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(v) AS BIGINT) AS non_null,
  round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
  round(avg(v), 9) AS mean, round(stddev_samp(v), 6) AS std,
  round(avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5), 6) AS skewness,
  round(avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) - 3.0, 6) AS kurtosis,
  round(min(v), 6) AS min, round(max(v), 6) AS max,
  CAST(count(DISTINCT v) AS BIGINT) AS unique_count,
  coalesce(bool_and(v = floor(v)), false) AS is_integer, coalesce(bool_and(v > 0), false) AS is_positive,
  CAST(count(*) FILTER (WHERE isinf(v)) AS BIGINT) AS n_inf
FROM long l JOIN m USING (feature) GROUP BY l.feature"""

_FLOATS = ["missing_rate", "mean", "std", "skewness", "kurtosis", "min", "max"]


@query("b02_numeric_moments", _MOMENTS_SQL)
def b02_numeric_moments(spark, sf):
    p = P.numeric_profile(_li(spark, sf), NUM).withColumn("mean", r6("mean", 9))
    return _round(p, [c for c in _FLOATS if c != "mean"])


@query("b01_base_profile", f"""
WITH {CUSTOMER_NULLS_SQL}, long AS ({long_sql('customer_n', ['c_acctbal', 'c_nationkey'])})
SELECT feature, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(v) AS BIGINT) AS non_null,
  round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate, true AS is_numeric
FROM long GROUP BY feature""")
def b01_base_profile(spark, sf):
    p = P.numeric_profile(customer_nulls(spark, sf), ["c_acctbal", "c_nationkey"])
    return p.select("feature", "n_rows", "non_null", r6("missing_rate").alias("missing_rate"),
                    F.lit(True).alias("is_numeric"))


@query("b03_distinct_count", f"""
WITH long AS ({long_sql('lineitem', NUM + ['l_partkey', 'l_orderkey'])})
SELECT feature, CAST(count(DISTINCT v) AS BIGINT) AS unique_count FROM long GROUP BY feature""")
def b03_distinct_count(spark, sf):
    return P.numeric_profile(_li(spark, sf), NUM + ["l_partkey", "l_orderkey"]).select("feature", "unique_count")


@query("b04_value_flags", f"""
WITH long AS ({long_sql('lineitem', NUM + ['l_linenumber'])})
SELECT feature, coalesce(bool_and(v = floor(v)), false) AS is_integer,
  coalesce(bool_and(v > 0), false) AS is_positive,
  (min(v) > CAST('-inf' AS DOUBLE) AND max(v) < CAST('inf' AS DOUBLE)) AS is_bounded
FROM long GROUP BY feature""")
def b04_value_flags(spark, sf):
    p = P.numeric_profile(_li(spark, sf), NUM + ["l_linenumber"])
    return p.select("feature", "is_integer", "is_positive",
                    ((F.col("min") > float("-inf")) & (F.col("max") < float("inf"))).alias("is_bounded"))


def _cat_sql(tab, cols, body):
    return f"""
WITH c AS ({counts_sql(tab, cols)}),
t AS (SELECT feature, sum(cnt) AS n, count(*) AS k FROM c GROUP BY feature),
p AS (SELECT c.*, CAST(cnt AS DOUBLE) / n AS p, n, k FROM c JOIN t USING (feature))
{body}"""


_CAT_BODY = """
SELECT feature, CAST(max(n) AS BIGINT) AS n, CAST(max(k) AS BIGINT) AS unique_count,
  round(CAST(max(k) AS DOUBLE) / max(n), 6) AS cardinality,
  arg_min(v, (-cnt, v)) AS mode, round(CAST(max(cnt) AS DOUBLE) / max(n), 6) AS mode_share
FROM p GROUP BY feature"""


@query("b05_categorical_summary", _cat_sql("customer", CAT_CUST, _CAT_BODY))
def b05_categorical_summary(spark, sf):
    p = P.categorical_profile(table(spark, sf, "customer"), CAT_CUST)
    return p.select("feature", "n", "unique_count", r6("cardinality").alias("cardinality"),
                    "mode", r6("mode_share").alias("mode_share"))


@query("b05_categorical_summary_orders", _cat_sql("orders", CAT_ORDERS, _CAT_BODY))
def b05_categorical_summary_orders(spark, sf):
    p = P.categorical_profile(table(spark, sf, "orders"), CAT_ORDERS)
    return p.select("feature", "n", "unique_count", r6("cardinality").alias("cardinality"),
                    "mode", r6("mode_share").alias("mode_share"))


@query("b06_entropy_gini", _cat_sql("orders", CAT_ORDERS + ["o_custkey"], """
SELECT feature, round(-sum(p * log2(p + 1e-12)), 6) AS entropy_bits, round(1.0 - sum(p * p), 6) AS gini
FROM p GROUP BY feature"""))
def b06_entropy_gini(spark, sf):
    p = P.categorical_profile(table(spark, sf, "orders"), CAT_ORDERS + ["o_custkey"])
    return p.select("feature", r6("entropy_bits").alias("entropy_bits"), r6("gini").alias("gini"))


@query("b08_normalized_entropy", _cat_sql("lineitem", ["l_returnflag", "l_linestatus", "l_suppkey"], """
SELECT feature, round(CASE WHEN max(k) > 1 THEN -sum(p * log2(p)) / log2(max(k)) ELSE -sum(p * log2(p)) END, 6)
  AS norm_entropy FROM p GROUP BY feature"""))
def b08_normalized_entropy(spark, sf):
    p = P.categorical_profile(_li(spark, sf), ["l_returnflag", "l_linestatus", "l_suppkey"])
    return p.select("feature", r6("norm_entropy").alias("norm_entropy"))


@query("b09_uniqueness_ratio", _cat_sql("customer", CAT_CUST + ["c_nationkey"], """
SELECT feature, round(CAST(max(k) AS DOUBLE) / max(n), 6) AS uniqueness FROM p GROUP BY feature"""))
def b09_uniqueness_ratio(spark, sf):
    p = P.categorical_profile(table(spark, sf, "customer"), CAT_CUST + ["c_nationkey"])
    return p.select("feature", r6("uniqueness").alias("uniqueness"))


@query("b11_entropy_nats", _cat_sql("orders", CAT_ORDERS, """
SELECT feature, round(-sum(p * ln(p)), 6) AS entropy_nats, CAST(max(k) AS BIGINT) AS unique_count
FROM p GROUP BY feature"""))
def b11_entropy_nats(spark, sf):
    p = P.categorical_profile(table(spark, sf, "orders"), CAT_ORDERS)
    return p.select("feature", r6("entropy_nats").alias("entropy_nats"), "unique_count")


@query("b10_numeric_quartiles", f"""
WITH long AS ({long_sql('lineitem', NUM)})
SELECT feature, round(avg(v), 9) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
  round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50,
  round(quantile_cont(v, 0.75), 6) AS q75
FROM long GROUP BY feature""")
def b10_numeric_quartiles(spark, sf):
    s = P.numeric_summary(_li(spark, sf), NUM).withColumn("mean", r6("mean", 9))
    return _round(s, ["std", "min", "max", "q25", "q50", "q75"])


_KS_SQL = f"""
WITH long AS ({long_sql('lineitem', NUM)}),
st AS (SELECT feature, avg(v) AS mu, stddev_samp(v) AS sd, count(v) AS n FROM long GROUP BY feature),
vc AS (SELECT feature, v, count(*) AS cnt FROM long WHERE v IS NOT NULL GROUP BY feature, v),
cum AS (SELECT feature, v, cnt, sum(cnt) OVER (PARTITION BY feature ORDER BY v) AS c FROM vc),
z AS (SELECT cum.*, st.n, {phi_sql('((v - mu) / sd)')} AS cdf FROM cum JOIN st USING (feature)),
d AS (SELECT feature, max(greatest(c / n - cdf, cdf - (c - cnt) / n)) AS ks, max(n) AS n FROM z GROUP BY feature)
SELECT feature, round(ks, 6) AS ks_statistic, round({kolmogorov_sql('ks * sqrt(n)')}, 6) AS ks_p_value FROM d"""


@query("b12_ks_normal", _KS_SQL)
def b12_ks_normal(spark, sf):
    return _round(P.ks_normal(_li(spark, sf), NUM), ["ks_statistic", "ks_p_value"])


_AD_SQL = f"""
WITH long AS ({long_sql('lineitem', NUM)}),
st AS (SELECT feature, avg(v) AS mu, stddev_samp(v) AS sd, count(v) AS n FROM long GROUP BY feature),
srt AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS j FROM long WHERE v IS NOT NULL),
z AS (SELECT srt.*, st.n, {phi_sql('((v - mu) / sd)')} AS cdf FROM srt JOIN st USING (feature))
SELECT feature, round(-max(n) - sum((2 * j - 1) * ln(cdf) + (2 * n + 1 - 2 * j) * ln(1 - cdf)) / max(n), 4)
  AS anderson_statistic FROM z GROUP BY feature"""


@query("b13_anderson_darling", _AD_SQL)
def b13_anderson_darling(spark, sf):
    a = P.anderson_darling(_li(spark, sf), NUM)
    return a.select("feature", r6("anderson_statistic", 4).alias("anderson_statistic"))


@query("b14_jarque_bera", f"""
WITH long AS ({long_sql('lineitem', NUM)}),
m AS (SELECT feature, avg(v) AS mu FROM long GROUP BY feature),
mo AS (SELECT feature, count(v) AS n, avg(power(v - mu, 3)) / power(avg(power(v - mu, 2)), 1.5) AS s,
         avg(power(v - mu, 4)) / power(avg(power(v - mu, 2)), 2) - 3.0 AS k
       FROM long JOIN m USING (feature) GROUP BY feature)
SELECT feature, round(n / 6.0 * (s * s + k * k / 4.0), 4) AS jb_statistic,
  round(exp(-(n / 6.0 * (s * s + k * k / 4.0)) / 2.0), 6) AS jb_p_value,
  exp(-(n / 6.0 * (s * s + k * k / 4.0)) / 2.0) > 0.05 AS is_gaussian FROM mo""")
def b14_jarque_bera(spark, sf):
    jb = P.jarque_bera(P.numeric_profile(_li(spark, sf), NUM))
    return jb.select("feature", r6("jb_statistic", 4).alias("jb_statistic"), r6("jb_p_value").alias("jb_p_value"),
                     "is_gaussian")


def _poly_sql(coefs, x):
    return "(" + " + ".join(f"({c!r}) * power({x}, {k})" for k, c in enumerate(coefs)) + ")"


# the SQL is for more than 11 values
@query("b14_shapiro_wilk", f"""
WITH long AS ({long_sql('customer', ['c_acctbal'])}),
s AS (SELECT feature, count(v) AS n, avg(v) AS mu, var_samp(v) * (count(v) - 1) AS ss FROM long GROUP BY feature),
r AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) AS i FROM long WHERE v IS NOT NULL),
m AS (SELECT r.*, n, mu, ss, {phi_inv_sql("((i - 0.375) / (n + 0.25))")} AS m FROM r JOIN s USING (feature) WHERE n <= 5000),
t AS (SELECT feature, sum(m * m) AS mm, max(m) AS top, max(m) FILTER (WHERE i = n - 1) AS second,
             {_poly_sql(P.SW_LARGEST, "(1 / sqrt(max(n)))")} + max(m) / sqrt(sum(m * m)) AS a1,
             {_poly_sql(P.SW_SECOND, "(1 / sqrt(max(n)))")} + max(m) FILTER (WHERE i = n - 1) / sqrt(sum(m * m)) AS a2
      FROM m GROUP BY feature),
w AS (SELECT feature, power(sum((v - mu) * CASE WHEN i = n THEN a1 WHEN i = 1 THEN -a1 WHEN i = n - 1 THEN a2 WHEN i = 2 THEN -a2
               ELSE m / sqrt((mm - 2 * top * top - 2 * second * second) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) END), 2) / max(ss) AS w
      FROM m JOIN t USING (feature) GROUP BY feature),
z AS (SELECT feature, n, w, (ln(1 - w) - {_poly_sql(P.SW_MEAN, "ln(n)")}) / exp({_poly_sql(P.SW_SD, "ln(n)")}) AS z
      FROM s LEFT JOIN w USING (feature))
SELECT feature, n, round(w, 6) AS shapiro_w, round(1 - {phi_sql("z")}, 6) AS shapiro_p, 1 - {phi_sql("z")} > 0.05 AS is_gaussian
FROM z""")
def b14_shapiro_wilk(spark, sf):
    w = P.shapiro_wilk(table(spark, sf, "customer"), ["c_acctbal"])
    return w.select("feature", "n", r6("shapiro_w").alias("shapiro_w"), r6("shapiro_p").alias("shapiro_p"), "is_gaussian")


@query("b16_tail_behavior", f"""
WITH long AS ({long_sql('orders', ['o_totalprice'])} UNION ALL {long_sql('lineitem', ['l_extendedprice', 'l_quantity'])}),
thr AS (SELECT feature, quantile_cont(v, 0.9) AS thr FROM long GROUP BY feature),
ex AS (SELECT feature, v - thr AS e FROM long JOIN thr USING (feature) WHERE v > thr),
{T.fit_sql("ex")}
SELECT feature, round(thr, 6) AS thr, CAST(coalesce(n, 0) AS BIGINT) AS n_excess,
  round(CASE WHEN n > 10 THEN shape END, 3) AS tail_index,
  CASE WHEN coalesce(n, 0) <= 10 THEN 'INSUFFICIENT_DATA' WHEN shape IS NULL THEN 'UNKNOWN'
       WHEN shape < 0.3 THEN 'LIGHT_TAILED' WHEN shape < 1.0 THEN 'MODERATE_TAILED' ELSE 'HEAVY_TAILED' END AS tail_behavior
FROM thr LEFT JOIN gpd USING (feature)""")
def b16_tail_behavior(spark, sf):
    long = _li(spark, sf)
    t = T.tail_behavior(table(spark, sf, "orders"), ["o_totalprice"]).unionByName(
        T.tail_behavior(long, ["l_extendedprice", "l_quantity"]))
    return t.select("feature", r6("thr").alias("thr"), "n_excess", r6("tail_index", 3).alias("tail_index"),
                    "tail_behavior")


@query("b17_hierarchy", """
WITH long AS (
  SELECT 'url' AS feature, url AS v FROM pages UNION ALL
  SELECT 'n_name', n_name FROM nation UNION ALL
  SELECT 'event_type', event_type FROM events UNION ALL
  SELECT 'p_type', p_type FROM part),
c AS (SELECT feature, v, count(*) AS cnt FROM long WHERE v IS NOT NULL GROUP BY feature, v),
a AS (SELECT feature,
  bool_or(contains(v, '>')) AS h0, max(len(string_split(v, '>'))) AS l0, min(CASE WHEN contains(v, '>') THEN v END) AS e0,
  bool_or(contains(v, '/')) AS h1, max(len(string_split(v, '/'))) AS l1, min(CASE WHEN contains(v, '/') THEN v END) AS e1,
  bool_or(contains(v, '|')) AS h2, max(len(string_split(v, '|'))) AS l2, min(CASE WHEN contains(v, '|') THEN v END) AS e2,
  bool_or(contains(v, ':')) AS h3, max(len(string_split(v, ':'))) AS l3, min(CASE WHEN contains(v, ':') THEN v END) AS e3,
  bool_or(regexp_matches(v, '[A-Za-z]+[_\\-]\\d+')) AS hp,
  min(CASE WHEN regexp_matches(v, '[A-Za-z]+[_\\-]\\d+') THEN v END) AS ep,
  max(cnt) AS mx, quantile_cont(cnt, 0.5) AS med, arg_min(v, (-cnt, v)) AS top
  FROM c GROUP BY feature)
SELECT feature,
  (CASE WHEN h0 THEN l0 WHEN h1 THEN l1 WHEN h2 THEN l2 WHEN h3 THEN l3 WHEN hp THEN 2 WHEN mx > 5 * med THEN 2 ELSE 0 END) > 0 AS has_levels,
  CAST(CASE WHEN h0 THEN l0 WHEN h1 THEN l1 WHEN h2 THEN l2 WHEN h3 THEN l3 WHEN hp THEN 2 WHEN mx > 5 * med THEN 2 ELSE 0 END AS INTEGER) AS levels_detected,
  CASE WHEN h0 THEN e0 WHEN h1 THEN e1 WHEN h2 THEN e2 WHEN h3 THEN e3 WHEN hp THEN ep WHEN mx > 5 * med THEN top END AS example_pattern
FROM a""")
def b17_hierarchy(spark, sf):
    parts = [
        P.hierarchy(table(spark, sf, "pages").select(F.col("url")), ["url"]),
        P.hierarchy(table(spark, sf, "nation"), ["n_name"]),
        P.hierarchy(table(spark, sf, "events"), ["event_type"]),
        P.hierarchy(table(spark, sf, "part"), ["p_type"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("feature", "has_levels", F.col("levels_detected").cast("int").alias("levels_detected"),
                      "example_pattern")


@query("b18_ordinality", """
WITH long AS (
  SELECT 'p_size_text' AS feature, CAST(p_size AS VARCHAR) AS v FROM part UNION ALL
  SELECT 'p_brand', p_brand FROM part UNION ALL
  SELECT 'qty_text', CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem UNION ALL
  SELECT 'price_text', CAST(p_retailprice AS VARCHAR) FROM part),
d AS (SELECT DISTINCT feature, v, TRY_CAST(v AS DOUBLE) AS x FROM long WHERE v IS NOT NULL),
parsed AS (SELECT feature, bool_and(x IS NOT NULL) AS all_numeric FROM d GROUP BY feature),
dx AS (SELECT DISTINCT feature, x FROM d WHERE x IS NOT NULL),
g AS (SELECT feature, lead(x) OVER (PARTITION BY feature ORDER BY x) - x AS g FROM dx),
gs AS (SELECT feature, stddev_pop(g) / avg(g) AS cv FROM g WHERE g IS NOT NULL GROUP BY feature)
SELECT p.feature, p.all_numeric, round(gs.cv, 6) AS gap_cv, p.all_numeric AND coalesce(gs.cv < 0.3, false) AS is_ordinal
FROM parsed p LEFT JOIN gs USING (feature)""")
def b18_ordinality(spark, sf):
    part = table(spark, sf, "part")
    li = _li(spark, sf)
    a = P.ordinality(part.select(F.col("p_size").cast("string").alias("p_size_text"), "p_brand",
                                 F.col("p_retailprice").cast("string").alias("price_text")),
                     ["p_size_text", "p_brand", "price_text"])
    b = P.ordinality(li.select(F.col("l_quantity").cast("bigint").cast("string").alias("qty_text")), ["qty_text"])
    out = a.unionByName(b)
    return out.select("feature", "all_numeric", r6("gap_cv").alias("gap_cv"), "is_ordinal")


@query("b19_cyclicity", """
WITH src AS (
  SELECT hour(ts) AS ev_hour, CAST(dayofweek(ts) AS BIGINT) AS ev_dow, month(ts) AS ev_mon,
         user_id AS uid, CAST(value AS BIGINT) % 12 + 1 AS bucket12 FROM events),
long AS (
  SELECT 'ev_hour' AS feature, CAST(ev_hour AS DOUBLE) AS v FROM src UNION ALL
  SELECT 'ev_dow', ev_dow FROM src UNION ALL SELECT 'ev_mon', ev_mon FROM src UNION ALL
  SELECT 'uid', uid FROM src UNION ALL SELECT 'bucket12', bucket12 FROM src),
p AS (SELECT feature, count(DISTINCT v) AS u, min(v) AS lo, max(v) AS hi, bool_and(v = floor(v)) AS isint FROM long GROUP BY feature)
SELECT feature, (contains(lower(feature), 'month') OR contains(lower(feature), 'day') OR contains(lower(feature), 'weekday')
   OR contains(lower(feature), 'season') OR contains(lower(feature), 'hour') OR contains(lower(feature), 'minute')
   OR (isint AND ((u <= 12 AND lo >= 1 AND hi <= 12) OR (u <= 7 AND lo >= 0 AND hi <= 6) OR (u <= 24 AND lo >= 0 AND hi <= 23))))
  AS is_cyclic FROM p""")
def b19_cyclicity(spark, sf):
    e = table(spark, sf, "events")
    src = e.select(F.hour("ts").alias("ev_hour"), (F.dayofweek("ts") - 1).alias("ev_dow"),
                   F.month("ts").alias("ev_mon"), F.col("user_id").alias("uid"),
                   (F.col("value").cast("bigint") % 12 + 1).alias("bucket12"))
    return P.cyclicity(P.numeric_profile(src, ["ev_hour", "ev_dow", "ev_mon", "uid", "bucket12"]))


@query("b22_column_health", f"""
WITH {CUSTOMER_NULLS_SQL},
src AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS half_missing,
               CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS third_missing,
               CASE WHEN c_custkey % 5 = 0 THEN CAST('inf' AS DOUBLE) ELSE c_acctbal END AS with_inf FROM customer_n),
long AS ({long_sql('src', ['half_missing', 'third_missing', 'with_inf'])})
SELECT feature, round(avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END), 6) AS missing_rate,
  CAST(count(*) FILTER (WHERE isinf(v)) AS BIGINT) AS n_inf,
  avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 OR count(*) FILTER (WHERE isinf(v)) > 0 AS has_error
FROM long GROUP BY feature""")
def b22_column_health(spark, sf):
    c = customer_nulls(spark, sf)
    k = F.col("c_custkey")
    src = c.select(F.when(k % 2 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("half_missing"),
                   F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("third_missing"),
                   F.when(k % 5 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("with_inf"))
    h = P.column_health(P.numeric_profile(src, ["half_missing", "third_missing", "with_inf"]))
    return h.select("feature", r6("missing_rate").alias("missing_rate"), "n_inf", "has_error")


@query("b23_temporal_detect", """
WITH o AS (SELECT o_orderkey, o_orderdate, o_totalprice, o_orderpriority,
                  strftime(o_orderdate, '%Y-%m-%d') AS o_date_text,
                  CAST(epoch(o_orderdate) AS BIGINT) + 200000000 AS o_unix FROM orders)
SELECT 'o_orderdate' AS feature, true AS is_temporal
UNION ALL SELECT 'o_totalprice', min(o_totalprice) > 1e9 AND max(o_totalprice) < 2e9 FROM o
UNION ALL SELECT 'o_unix', min(o_unix) > 1e9 AND max(o_unix) < 2e9 FROM o
UNION ALL SELECT 'o_orderpriority', coalesce(bool_and(TRY_CAST(v AS TIMESTAMP) IS NOT NULL), false)
  OR coalesce(avg(CAST(regexp_matches(v, '^(\\d{4}-\\d{2}-\\d{2}|\\d{2}/\\d{2}/\\d{4}|\\d{4}/\\d{2}/\\d{2}|\\d{2}-\\d{2}-\\d{4})') AS DOUBLE)) >= 0.1, false)
  FROM (SELECT o_orderpriority AS v FROM o)
UNION ALL SELECT 'o_date_text', coalesce(bool_and(TRY_CAST(v AS TIMESTAMP) IS NOT NULL), false)
  FROM (SELECT o_date_text AS v FROM o)""")
def b23_temporal_detect(spark, sf):
    o = table(spark, sf, "orders")
    src = o.select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority",
                   F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_date_text"),
                   (F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 200000000).alias("o_unix"))
    return P.temporal_detect(src, "o_orderkey")


@query("b15_multimodality", """
WITH long AS (SELECT 'value' AS feature, CAST(value AS DOUBLE) AS v FROM events
  UNION ALL SELECT 'l_quantity', CAST(l_quantity AS DOUBLE) FROM lineitem UNION ALL SELECT 'l_discount', CAST(l_discount AS DOUBLE) FROM lineitem),
st AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(v) AS n, stddev_samp(v) AS sd FROM long WHERE v IS NOT NULL GROUP BY feature),
hist AS (SELECT feature, least(floor((v - lo) / ((hi - lo) / 2048)), 2047) AS b, count(*) AS c FROM long JOIN st USING (feature)
  WHERE v IS NOT NULL GROUP BY feature, b),
dens AS (SELECT feature, gi, sum(c * exp(-0.5 * power((lo + gi * (hi - lo) / 999 - (lo + (b + 0.5) * ((hi - lo) / 2048))) / (sd * power(n, -0.2)), 2)))
    / (any_value(n) * any_value(sd * power(n, -0.2)) * sqrt(2 * pi())) AS d
  FROM hist JOIN st USING (feature), range(1000) AS t(gi) GROUP BY feature, gi),
pk AS (SELECT feature, d, lag(d) OVER w AS dp, lead(d) OVER w AS dn FROM dens WINDOW w AS (PARTITION BY feature ORDER BY gi)),
n AS (SELECT feature, count(*) FILTER (d > dp AND d > dn AND d >= 0.01) AS n_peaks FROM pk GROUP BY feature)
SELECT feature, n_peaks, CAST(least(1.0, n_peaks * 0.3) AS DOUBLE) AS multimodality_score, least(1.0, n_peaks * 0.3) > 0.3 AS is_multimodal FROM n""")
def b15_multimodality(spark, sf):
    e = table(spark, sf, "events").select("value")
    li = _li(spark, sf).select("l_quantity", "l_discount")
    return P.multimodality(e, ["value"]).unionByName(P.multimodality(li, ["l_quantity", "l_discount"]))


def _pl_ctes(tab, col):
    return f"""fr AS (SELECT {col}, count(*) AS x FROM {tab} WHERE {col} IS NOT NULL GROUP BY {col}),
cc AS (SELECT x, count(*) AS m FROM fr GROUP BY x),
c AS (SELECT x, m, sum(m) OVER (ORDER BY x) AS cum_m, sum(m) OVER () AS tot_m,
        sum(m * ln(x)) OVER (ORDER BY x) AS cum_l, sum(m * ln(x)) OVER () AS tot_l FROM cc),
t AS (SELECT x, m, cum_m, tot_m, tot_m - cum_m + m AS n_tail, tot_l - cum_l + m * ln(x) AS sum_ln FROM c),
cand AS (SELECT x AS x_min, n_tail, tot_m, cum_m - m AS before, sum_ln - n_tail * ln(x) AS s
         FROM t WHERE n_tail >= 100 AND n_tail / tot_m >= 0.05),
ca AS (SELECT *, 1 + n_tail / s AS alpha FROM cand WHERE s > 0),
ks AS (SELECT x_min, alpha, n_tail, max(abs((cu - before) / n_tail - (1 - power(u / x_min, 1 - alpha)))) AS ks
       FROM (SELECT x AS u, cum_m AS cu FROM c) JOIN ca ON u >= x_min GROUP BY x_min, alpha, n_tail),
best AS (SELECT arg_min(x_min, (ks, x_min)) AS x_min, arg_min(alpha, (ks, x_min)) AS alpha,
           arg_min(n_tail, (ks, x_min)) AS n_tail, min(ks) AS ks FROM ks),
sup AS (SELECT sum(m) AS support_size FROM cc)"""


def _pl_sql(tab, col):
    return f"""WITH {_pl_ctes(tab, col)}
SELECT '{col}' AS feature, CAST(support_size AS BIGINT) AS support_size, CAST(x_min AS BIGINT) AS x_min, round(alpha, 6) AS alpha,
  round(ks, 6) AS ks, CAST(n_tail AS BIGINT) AS n_tail, round(n_tail / support_size, 6) AS tail_fraction,
  coalesce(support_size >= 50 AND x_min IS NOT NULL AND alpha BETWEEN 1.2 AND 5.0 AND ks <= 0.2, false) AS is_power_law
FROM sup, best"""


def _pl_round(df):
    return df.select("feature", F.col("support_size").cast("bigint"), F.col("x_min").cast("bigint"),
                     r6("alpha").alias("alpha"), r6("ks").alias("ks"), F.col("n_tail").cast("bigint"),
                     r6("tail_fraction").alias("tail_fraction"), "is_power_law")


@query("b20_power_law_partkey", _pl_sql("lineitem", "l_partkey"))
def b20_power_law_partkey(spark, sf):
    return _pl_round(PL.power_law_fit(_li(spark, sf), "l_partkey"))


@query("b20_power_law_words", _pl_sql("(SELECT unnest(string_split(text, ' ')) AS word FROM documents)", "word"))
def b20_power_law_words(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word"))
    return _pl_round(PL.power_law_fit(words, "word"))


@query("b21_power_law_bootstrap", f"""WITH {_pl_ctes('lineitem', 'l_partkey')},
i AS (SELECT run, unnest(range(1, CAST(n_tail AS BIGINT) + 1)) AS i, best.* FROM best, range(1, 201) AS t(run)),
x AS (SELECT run, x_min, alpha, n_tail, ks,
  greatest(round(x_min * power(greatest({hu_sql(42, 'run', 'i')}, 1e-300), 1.0 / (1.0 - alpha))), CAST(x_min AS DOUBLE)) AS x FROM i),
v AS (SELECT run, x, x_min, alpha, n_tail, ks, count(*) AS m FROM x GROUP BY ALL),
rc AS (SELECT *, sum(m) OVER (PARTITION BY run ORDER BY x) AS cum FROM v),
p AS (SELECT run, ks, max(abs(cum / n_tail - (1.0 - power(x / x_min, 1.0 - alpha)))) AS ks_sim FROM rc GROUP BY run, ks)
SELECT round(avg(CAST(ks_sim >= ks AS DOUBLE)), 6) AS p_value, count(*) AS runs FROM p""")
def b21_power_law_bootstrap(spark, sf):
    fit = PL.power_law_fit(_li(spark, sf), "l_partkey")
    return PL.power_law_bootstrap(fit, runs=200).select(r6("p_value").alias("p_value"), "runs")
