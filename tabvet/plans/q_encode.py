"""Encoding / decoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.hashing import hu_sql
from tabvet.operators import encode as E
from tabvet.operators import typing as TY
from tabvet.functions.normal import phi_inv_sql
from tabvet.plans.registry import query, r6
from tabvet.session import table
from tabvet.sources.fixtures import CUSTOMER_NULLS_SQL, customer_nulls

_IMP = f"""{CUSTOMER_NULLS_SQL},
med AS (SELECT quantile_cont(c_acctbal, 0.5) AS m FROM customer_n),
imp AS (SELECT c_custkey, coalesce(c_acctbal, m) AS x FROM customer_n, med)"""


@query("d01_median_impute", f"""
WITH {_IMP} SELECT c_custkey, round(x, 6) AS c_acctbal FROM imp""")
def d01_median_impute(spark, sf):
    enc = E.ContinuousEncoder(["c_acctbal"], scaling="none").fit(customer_nulls(spark, sf))
    out = enc.transform(customer_nulls(spark, sf))
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


@query("d02_standard_scale", f"""
WITH {_IMP}, s AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM imp)
SELECT c_custkey, round((x - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END, 6) AS c_acctbal FROM imp, s""")
def d02_standard_scale(spark, sf):
    df = customer_nulls(spark, sf)
    out = E.ContinuousEncoder(["c_acctbal"], scaling="standard").fit(df).transform(df)
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


@query("d03_robust_scale", f"""
WITH {_IMP}, s AS (SELECT quantile_cont(x, 0.5) AS md, quantile_cont(x, 0.95) - quantile_cont(x, 0.05) AS rg FROM imp)
SELECT c_custkey, round((x - md) / CASE WHEN rg = 0 THEN 1 ELSE rg END, 6) AS c_acctbal FROM imp, s""")
def d03_robust_scale(spark, sf):
    df = customer_nulls(spark, sf)
    out = E.ContinuousEncoder(["c_acctbal"], scaling="robust").fit(df).transform(df)
    return out.select("c_custkey", r6("c_acctbal").alias("c_acctbal"))


@query("d04_minmax_scale", """
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo) * 2 - 1, 6) AS o_totalprice FROM orders, s""")
def d04_minmax_scale(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    out = E.ContinuousEncoder(["o_totalprice"], scaling="minmax").fit(o).transform(o)
    return out.select("o_orderkey", r6("o_totalprice").alias("o_totalprice"))


@query("d05_inverse_scale", f"""
WITH {_IMP} SELECT c_custkey, round(x, 4) AS c_acctbal, round(x, 4) AS decoded FROM imp""")
def d05_inverse_scale(spark, sf):
    df = customer_nulls(spark, sf)
    enc = E.ContinuousEncoder(["c_acctbal"], scaling="robust").fit(df)
    z = enc.transform(df).select("c_custkey", "c_acctbal")
    back = enc.inverse(z).withColumnRenamed("c_acctbal", "decoded")
    imputed = E.ContinuousEncoder(["c_acctbal"], scaling="none").fit(df).transform(df).select("c_custkey", "c_acctbal")
    return imputed.join(back, "c_custkey").select("c_custkey", r6("c_acctbal", 4).alias("c_acctbal"),
                                                  r6("decoded", 4).alias("decoded"))


def _onehot_sql(col: str, k: int) -> str:
    return ",\n".join(
        f"CAST(coalesce(CAST({col} AS VARCHAR), '__MISSING__') = (SELECT v FROM cats_{col} WHERE i = {i}) AS DOUBLE) AS {col}_{i}"
        for i in range(k))


def _cats_sql(col: str, src: str) -> str:
    return (f"cats_{col} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM "
            f"(SELECT DISTINCT coalesce(CAST({col} AS VARCHAR), '__MISSING__') AS v FROM {src}))")


@query("d06_one_hot", f"""
WITH {_cats_sql('o_orderpriority', 'orders')}, {_cats_sql('o_orderstatus', 'orders')}
SELECT o_orderkey, {_onehot_sql('o_orderpriority', 5)}, {_onehot_sql('o_orderstatus', 3)} FROM orders""")
def d06_one_hot(spark, sf):
    o = table(spark, sf, "orders")
    enc = E.OneHotEncoder(["o_orderpriority", "o_orderstatus"]).fit(o)
    return enc.transform(o, keep=["o_orderkey"])


@query("d07_label_encoding", """
SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_name) - 1 AS BIGINT) AS c_name,
  CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment FROM customer""")
def d07_label_encoding(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    a = E.LabelEncoder("c_name").fit(c).transform(c)
    b = E.LabelEncoder("c_mktsegment").fit(c).transform(a)
    return b.select("c_custkey", F.col("c_name").cast("bigint"), F.col("c_mktsegment").cast("bigint"))


PRIORITY_ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query("d08_ordinal_encoding", f"""
SELECT o_orderkey, CAST(list_position({PRIORITY_ORDER!r}, o_orderpriority) - 1 AS INTEGER) AS o_orderpriority
FROM orders""")
def d08_ordinal_encoding(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return E.LabelEncoder("o_orderpriority", order=PRIORITY_ORDER).transform(o).select(
        "o_orderkey", F.col("o_orderpriority").cast("int"))


@query("d09_inverse_categorical", """
SELECT o_orderkey, o_orderpriority, o_orderstatus, c_decoded FROM orders
JOIN (SELECT c_custkey, c_mktsegment AS c_decoded FROM customer) ON c_custkey = o_custkey""")
def d09_inverse_categorical(spark, sf):
    o = table(spark, sf, "orders")
    enc = E.OneHotEncoder(["o_orderpriority", "o_orderstatus"]).fit(o)
    back = enc.inverse(enc.transform(o, keep=["o_orderkey", "o_custkey"]))
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    le = E.LabelEncoder("c_mktsegment").fit(c)
    codes = le.transform(c).select("c_custkey", "c_mktsegment")
    dec = le.inverse(codes).select("c_custkey", F.col("c_mktsegment").alias("c_decoded"))
    return back.join(dec, back["o_custkey"] == dec["c_custkey"]).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "c_decoded")


_DT_SQL = """dt AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo,
  CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS dow,
  CAST(isodow(o_orderdate) - 1 >= 5 AS INTEGER) AS we FROM orders)"""


@query("d10_datetime_parts", f"""
WITH {_DT_SQL} SELECT o_orderkey, y AS o_orderdate_year, mo AS o_orderdate_month, d AS o_orderdate_day,
  h AS o_orderdate_hour, dow AS o_orderdate_dayofweek, we AS o_orderdate_is_weekend FROM dt""")
def d10_datetime_parts(spark, sf):
    o = table(spark, sf, "orders")
    parts = E.datetime_parts(o, "o_orderdate")
    return o.select("o_orderkey", *[v.alias(k) for k, v in parts.items()])


def _z(col, alias):
    return f"round(({col} - avg({col}) OVER ()) / (stddev_samp({col}) OVER () + 1e-8), 6) AS {alias}"


@query("d11_datetime_zscore", f"""
WITH {_DT_SQL} SELECT o_orderkey, {_z('y', 'o_orderdate_year')}, {_z('mo', 'o_orderdate_month')},
  {_z('d', 'o_orderdate_day')}, {_z('h', 'o_orderdate_hour')}, {_z('dow', 'o_orderdate_dayofweek')},
  {_z('we', 'o_orderdate_is_weekend')} FROM dt""")
def d11_datetime_zscore(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    out = E.DatetimeEncoder("o_orderdate").fit(o).transform(o)
    return out.select("o_orderkey", *[r6(c).alias(c) for c in out.columns if c != "o_orderkey"])


@query("d12_datetime_inverse", """
SELECT o_orderkey, make_timestamp(year(o_orderdate), month(o_orderdate), least(day(o_orderdate), 28), 0, 0, 0) AS o_orderdate
FROM orders""")
def d12_datetime_inverse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    enc = E.DatetimeEncoder("o_orderdate").fit(o)
    z = enc.transform(o)
    return enc.inverse(z).select("o_orderkey", F.col("o_orderdate"))


@query("d13_parse_temporal", """
SELECT o_orderkey, CAST(strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d') AS TIMESTAMP) AS from_text,
  CAST(to_timestamp(CAST(epoch(o_orderdate) AS BIGINT)) AS TIMESTAMP) AS from_unix FROM orders""")
def d13_parse_temporal(spark, sf):
    o = table(spark, sf, "orders")
    src = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d_text"),
                   F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("d_unix"))
    return src.select("o_orderkey", E.parse_temporal(src, "d_text").alias("from_text"),
                      E.parse_temporal(src, "d_unix").alias("from_unix"))


def _events_nulls(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit(None)).otherwise(F.col("ts")).alias("ts"))


_CYC = []
for _k, _e, _p in (("hour", "hour(t)", 24.0), ("dow", "(isodow(t) - 1)", 7.0), ("month", "month(t)", 12.0),
                   ("doy", "dayofyear(t)", 365.0)):
    _CYC.append(f"round(sin(2 * pi() * {_e} / {_p}), 6) AS {_k}_sin, round(cos(2 * pi() * {_e} / {_p}), 6) AS {_k}_cos")


@query("d14_cyclical_time", f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts FROM events),
m AS (SELECT make_timestamp(CAST(round(quantile_cont(epoch_us(ts), 0.5)) AS BIGINT)) AS med FROM e),
t AS (SELECT event_id, coalesce(ts, med) AS t FROM e, m)
SELECT event_id, {', '.join(_CYC)} FROM t""")
def d14_cyclical_time(spark, sf):
    e = _events_nulls(spark, sf)
    out = E.cyclical_time(e, "ts")
    return out.select("event_id", *[r6(c).alias(c) for c in out.columns if c not in ("event_id", "ts")])


@query("d15_sincos_period", """
SELECT event_id, round(sin(2 * pi() * hour(ts) / 24.0), 6) AS ev_hour_sin, round(cos(2 * pi() * hour(ts) / 24.0), 6) AS ev_hour_cos
FROM events""")
def d15_sincos_period(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", *E.sincos(F.hour("ts"), 24, "ev_hour")) \
        .select("event_id", r6("ev_hour_sin").alias("ev_hour_sin"), r6("ev_hour_cos").alias("ev_hour_cos"))


def _hash_sql(col: str, n: int) -> str:
    r = f"(CAST(('0x' || right(md5(CAST({col} AS VARCHAR)), 2)) AS INTEGER) % {2 * n})"
    return ",\n".join(
        f"CAST(CASE WHEN {col} IS NOT NULL AND {r} % {n} = {i} THEN CASE WHEN ({r} // {n}) % 2 = 0 THEN 1.0 ELSE -1.0 END "
        f"ELSE 0.0 END AS DOUBLE) AS {col}_hash_{i}" for i in range(n))


@query("d16_feature_hashing", f"SELECT c_custkey, {_hash_sql('c_name', 32)} FROM customer")
def d16_feature_hashing(spark, sf):
    c = table(spark, sf, "customer")
    placed, h = E.feature_hashing(c, "c_name", 32)
    return placed.select("c_custkey", *[v.alias(k) for k, v in h.items()])


@query("d17_target_encoding", """
WITH g AS (SELECT avg(c_acctbal) AS gm FROM customer),
s AS (SELECT c_nationkey, (sum(c_acctbal) + 10 * gm) / (count(c_acctbal) + 10) AS e FROM customer, g GROUP BY c_nationkey, gm)
SELECT c_custkey, round(coalesce(e, gm), 6) AS c_nationkey_target_enc FROM customer LEFT JOIN s USING (c_nationkey), g""")
def d17_target_encoding(spark, sf):
    c = table(spark, sf, "customer")
    out = E.target_encoding(c, "c_nationkey", "c_acctbal", 10.0)
    return out.select("c_custkey", r6("c_nationkey_target_enc").alias("c_nationkey_target_enc"))


@query("d18_frequency_encoding", """
WITH s AS (SELECT o_custkey, count(*) / (SELECT count(*) FROM orders WHERE o_custkey IS NOT NULL) AS f FROM orders GROUP BY o_custkey)
SELECT o_orderkey, round(coalesce(f, 0), 9) AS o_custkey_freq FROM orders LEFT JOIN s USING (o_custkey)""")
def d18_frequency_encoding(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    out = E.frequency_encoding(o, "o_custkey")
    return out.select("o_orderkey", r6("o_custkey_freq", 9).alias("o_custkey_freq"))


@query("d19_binary_encoding", """
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linestatus IS NULL OR l_linestatus = (SELECT min(l_linestatus) FROM lineitem)
  THEN 0.0 ELSE 1.0 END AS DOUBLE) AS l_linestatus FROM lineitem""")
def d19_binary_encoding(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", E.binary_encoding(li, "l_linestatus").alias("l_linestatus"))


@query("d20_dummies", """
SELECT c_custkey,
  CAST(c_mktsegment = 'AUTOMOBILE' AS DOUBLE) AS c_mktsegment_AUTOMOBILE, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS c_mktsegment_BUILDING,
  CAST(c_mktsegment = 'FURNITURE' AS DOUBLE) AS c_mktsegment_FURNITURE, CAST(c_mktsegment = 'HOUSEHOLD' AS DOUBLE) AS c_mktsegment_HOUSEHOLD,
  CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS c_mktsegment_MACHINERY FROM customer""")
def d20_dummies(spark, sf):
    c = table(spark, sf, "customer")
    d = E.dummies(c, "c_mktsegment")
    return c.select("c_custkey", *[v.alias(k) for k, v in d.items()])


def _quantile_gauss_sql():
    probs = ", ".join(repr(i / 999) for i in range(1000))
    return f"""q AS (SELECT quantile_cont(CAST(o_totalprice AS DOUBLE), [{probs}]) AS q FROM orders),
x AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS x, q, len(list_filter(q, lambda v: v < CAST(o_totalprice AS DOUBLE))) AS l,
        len(list_filter(q, lambda v: v <= CAST(o_totalprice AS DOUBLE))) - 1 AS r FROM orders, q),
y AS (SELECT o_orderkey, x, CASE WHEN x - 1e-7 < q[1] THEN 0.0 WHEN x + 1e-7 > q[1000] THEN 1.0
        WHEN l <= r THEN (l / 999.0 + r / 999.0) / 2.0
        ELSE r / 999.0 + (x - q[r + 1]) * (l / 999.0 - r / 999.0) / (q[l + 1] - q[r + 1]) END AS y FROM x),
g AS (SELECT o_orderkey, x, CASE WHEN y <= 0 THEN -5.199337582187471 WHEN y >= 1 THEN 5.199337582187471
        ELSE least(greatest({phi_inv_sql('y')}, -5.199337582187471), 5.199337582187471) END AS g FROM y)"""


@query("d21_quantile_gaussian", f"WITH {_quantile_gauss_sql()} SELECT o_orderkey, round(g, 6) AS o_totalprice_gauss FROM g")
def d21_quantile_gaussian(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    qg = E.QuantileGaussian("o_totalprice").fit(o)
    return qg.transform(o, "g").select("o_orderkey", r6("g").alias("o_totalprice_gauss"))


@query("d22_quantile_inverse")
def d22_quantile_inverse(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    qg = E.QuantileGaussian("o_totalprice").fit(o)
    z = qg.transform(o, "z")
    back = qg.inverse(z, "z", "decoded")
    return back.select("o_orderkey", "o_totalprice", r6("decoded", 2).alias("decoded"))


@query("d23_boxcox")
def d23_boxcox(spark, sf):
    li = table(spark, sf, "lineitem")
    lam = E.boxcox_lambda(li, "l_extendedprice")
    return li.select("l_orderkey", "l_linenumber", F.lit(round(lam, 4)).alias("lambda"),
                     r6(E.boxcox(F.col("l_extendedprice"), lam)).alias("l_extendedprice_bc"))


@query("d24_log_offset", """
SELECT o_orderkey, round(ln(o_totalprice + 1), 6) AS o_totalprice_log FROM orders""")
def d24_log_offset(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", r6(E.log_offset(F.col("o_totalprice"))).alias("o_totalprice_log"))


@query("d25_impute_nonfinite", """
WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN CAST('inf' AS DOUBLE) WHEN c_custkey % 13 = 0 THEN CAST('nan' AS DOUBLE)
                                  ELSE c_acctbal END AS x FROM customer),
m AS (SELECT quantile_cont(x, 0.5) AS med FROM s WHERE NOT isinf(x) AND NOT isnan(x))
SELECT c_custkey, round(CASE WHEN isinf(x) OR isnan(x) THEN med ELSE x END, 6) AS x FROM s, m""")
def d25_impute_nonfinite(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    s = c.select("c_custkey", F.when(k % 11 == 0, F.lit(float("inf"))).when(k % 13 == 0, F.lit(float("nan")))
                 .otherwise(F.col("c_acctbal")).alias("x"))
    return E.impute_nonfinite(s, ["x"]).select("c_custkey", r6("x").alias("x"))


def _nd_sql(seed, key):
    u1 = f"greatest({hu_sql(f'{seed}a', key)}, 1e-300)"
    u2 = hu_sql(f"{seed}b", key)
    return f"(sqrt(-2.0 * ln({u1})) * cos(2 * 3.141592653589793 * {u2}))"


@query("d26_variance_guard", f"""
SELECT c_custkey, round(c_acctbal, 6) AS c_acctbal,
  round(1.0 + 0.0001 * {_nd_sql('42:flat', 'c_custkey')}, 9) AS flat FROM customer""")
def d26_variance_guard(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit(1.0).alias("flat"))
    g = E.variance_guard(c, ["c_acctbal", "flat"], key="c_custkey")
    return g.select("c_custkey", r6("c_acctbal").alias("c_acctbal"), r6("flat", 9).alias("flat"))


@query("d27_pca_projection")
def d27_pca_projection(spark, sf):
    li = table(spark, sf, "lineitem")
    p = E.pca_projection(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    return p.select(r6("pc0").alias("pc0"), r6("pc1").alias("pc1"))


@query("d29_numerical_health", """
WITH s AS (SELECT c_acctbal, CASE WHEN c_custkey % 9 = 0 THEN CAST('inf' AS DOUBLE) ELSE c_acctbal END AS b,
                  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS n FROM customer)
SELECT CAST(count(*) FILTER (WHERE n IS NULL) AS DOUBLE) AS n_nan, CAST(count(*) FILTER (WHERE isinf(b)) AS DOUBLE) AS n_inf,
  count(*) FILTER (WHERE n IS NULL) = 0 AS no_nan, count(*) FILTER (WHERE isinf(b)) = 0 AS no_inf FROM s""")
def d29_numerical_health(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    s = c.select("c_acctbal", F.when(k % 9 == 0, F.lit(float("inf"))).otherwise(F.col("c_acctbal")).alias("b"),
                 F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).alias("n"))
    h = E.numerical_health(s, ["c_acctbal", "b", "n"])
    return h.select("n_nan", "n_inf", "no_nan", "no_inf")


@query("d30_sanitize_names", """
SELECT p_partkey, CASE WHEN p_name IS NULL OR p_name = '' THEN 'unnamed_feature' ELSE
  regexp_replace(CASE WHEN regexp_matches(substr(s, 1, 1), '[0-9]') THEN 'f_' || s ELSE s END, '^_+|_+$', '', 'g') END AS p_name
FROM (SELECT p_partkey, p_name, regexp_replace(regexp_replace(p_name, '[^a-zA-Z0-9]', '_', 'g'), '_+', '_', 'g') AS s FROM part)""")
def d30_sanitize_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", E.sanitize_name_col(F.col("p_name")).alias("p_name"))


@query("d32_encoded_layout", """
WITH fs AS (SELECT * FROM (VALUES ('o_orderkey', 0), ('o_orderstatus', 1), ('o_totalprice', 2), ('o_orderpriority', 3)) AS t(feature, position)),
k AS (SELECT 'o_orderstatus' AS feature, count(DISTINCT o_orderstatus) AS k FROM orders UNION ALL
      SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders),
d AS (SELECT fs.feature, fs.position, CAST(CASE WHEN k.k IS NULL THEN 1 WHEN k.k < 25 THEN greatest(2, k.k) ELSE 1 END AS INTEGER) AS output_dim
      FROM fs LEFT JOIN k USING (feature))
SELECT feature, position, output_dim, CAST(sum(output_dim) OVER (ORDER BY position) - output_dim AS BIGINT) AS start,
  CAST(sum(output_dim) OVER (ORDER BY position) AS BIGINT) AS "end" FROM d""")
def d32_encoded_layout(spark, sf):
    cols = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    fs = TY.feature_schema(table(spark, sf, "orders"), cols)
    pos = spark.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, position int")
    sch = fs.join(F.broadcast(pos), "feature").select("feature", "position", "output_dim")
    out = E.layout(sch)
    return out.select("feature", "position", "output_dim", F.col("start").cast("bigint"), F.col("end").cast("bigint"))
