"""Semantic typing and relationship queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.functions.normal import phi_sql
from tabvet.operators import relations as R
from tabvet.operators import typing as TY
from tabvet.operators.information import digamma_sql, neighbour_information
from tabvet.plans.registry import query, r6
from tabvet.session import table

# --- fixture: orders with a binary and a constant column --------------------

ORD_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
            "is_urgent", "const_one"]


def _orders_x(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(*ORD_COLS[:6], (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_urgent"),
                    F.lit(1).alias("const_one"))


_ORD_X_SQL = """ox AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS is_urgent, 1 AS const_one FROM orders)"""

# schema facts of the fixture (numeric, integral, temporal)
_ORD_TYPES = {
    "o_orderkey": (True, True, False), "o_custkey": (True, True, False), "o_orderstatus": (False, False, False),
    "o_totalprice": (True, False, False), "o_orderdate": (False, False, True),
    "o_orderpriority": (False, False, False), "is_urgent": (True, True, False), "const_one": (True, True, False),
}


def _facts_sql(src: str, cols: list[str], types: dict) -> str:
    longs = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS v FROM {src}" for c in cols)
    nums = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(min({c}) AS DOUBLE) AS mn, CAST(max({c}) AS DOUBLE) AS mx FROM {src}"
        for c in cols if types[c][0])
    tys = ", ".join(f"('{c}', {str(t[0]).lower()}, {str(t[1]).lower()}, {str(t[2]).lower()})" for c, t in types.items()
                    if c in cols)
    return f"""
long AS ({longs}),
cnt AS (SELECT feature, v, count(*) AS c FROM long WHERE v IS NOT NULL GROUP BY feature, v),
tot AS (SELECT feature, sum(c) AS nn, count(*) AS k FROM cnt GROUP BY feature),
ent AS (SELECT feature, -sum(CAST(c AS DOUBLE) / nn * log2(CAST(c AS DOUBLE) / nn)) AS h2
        FROM cnt JOIN tot USING (feature) GROUP BY feature),
ty AS (SELECT * FROM (VALUES {tys}) AS t(feature, is_numeric, is_integral, is_temporal_type)),
mm AS ({nums}),
nr AS (SELECT count(*) AS n_rows FROM {src}),
facts AS (
  SELECT ty.*, tot.k, tot.nn, CAST(tot.k AS DOUBLE) / tot.nn AS u,
    CASE WHEN tot.k > 1 THEN ent.h2 / log2(tot.k) ELSE ent.h2 END AS h, mm.mn, mm.mx, nr.n_rows
  FROM ty LEFT JOIN tot USING (feature) LEFT JOIN ent USING (feature) LEFT JOIN mm USING (feature), nr)"""


@query("c03_semantic_types", f"""
WITH {_ORD_X_SQL}, {_facts_sql('ox', ORD_COLS, _ORD_TYPES)}
SELECT feature, CASE
  WHEN coalesce(k, 0) <= 1 THEN 'INVARIANT'
  WHEN is_temporal_type OR (is_numeric AND mn > 1e9 AND mx < 2e9) THEN 'TEMPORAL'
  WHEN k = 2 THEN 'BINARY'
  WHEN u > 0.95 AND is_numeric AND is_integral THEN CASE WHEN h > 0.95 THEN 'IDENTIFIER' ELSE 'CONTINUOUS' END
  WHEN u > 0.95 AND is_numeric THEN 'CONTINUOUS'
  WHEN u > 0.95 THEN 'IDENTIFIER'
  WHEN is_numeric THEN CASE WHEN k < 50 AND h < 0.8 THEN 'CATEGORICAL' ELSE 'CONTINUOUS' END
  WHEN k < 100 THEN 'CATEGORICAL' ELSE 'IDENTIFIER' END AS semantic_type
FROM facts""")
def c03_semantic_types(spark, sf):
    return TY.semantic_types(_orders_x(spark, sf), ORD_COLS)


@query("c04_feature_schema", f"""
WITH {_ORD_X_SQL}, {_facts_sql('ox', ORD_COLS, _ORD_TYPES)},
t AS (SELECT *, CASE WHEN is_numeric AND NOT (coalesce(k,0) < 15 OR (coalesce(k,0) / n_rows < 0.01 AND coalesce(k,0) < 50))
        THEN 'continuous' WHEN is_temporal_type THEN 'datetime' ELSE 'categorical' END AS ft FROM facts)
SELECT feature, ft AS feature_type,
  round(CASE WHEN ft = 'continuous' THEN coalesce(mn, 0.0) END, 6) AS min_value,
  round(CASE WHEN ft = 'continuous' THEN coalesce(mx, 1.0) END, 6) AS max_value,
  CASE WHEN ft = 'continuous' THEN 'robust' END AS scaling,
  CASE WHEN ft = 'categorical' THEN CASE WHEN k < 25 THEN 'onehot' ELSE 'label' END END AS encoding,
  CAST(CASE WHEN ft = 'continuous' THEN 1 WHEN ft = 'datetime' THEN 6 WHEN k < 25 THEN greatest(2, k) ELSE 1 END AS INTEGER) AS output_dim,
  CASE WHEN ft = 'categorical' THEN '__MISSING__' END AS default_value
FROM t""")
def c04_feature_schema(spark, sf):
    fs = TY.feature_schema(_orders_x(spark, sf), ORD_COLS)
    return fs.withColumn("min_value", r6("min_value")).withColumn("max_value", r6("max_value"))


@query("c05_relationship_types", f"""
WITH {_ORD_X_SQL}, {_facts_sql('ox', ORD_COLS, _ORD_TYPES)}
SELECT feature, CASE WHEN k = 2 THEN 'binary' WHEN is_numeric THEN 'numerical'
  WHEN coalesce(k, 0) < n_rows * 0.5 THEN 'categorical' ELSE 'categorical_high_cardinality' END AS relationship_type
FROM facts""")
def c05_relationship_types(spark, sf):
    return TY.relationship_types(_orders_x(spark, sf), ORD_COLS)


@query("c06_cli_metadata", f"""
WITH {_ORD_X_SQL}, {_facts_sql('ox', ORD_COLS, _ORD_TYPES)}
SELECT feature, CASE WHEN is_numeric THEN 'continuous' ELSE 'categorical' END AS type,
  round(CASE WHEN is_numeric THEN mn END, 6) AS min, round(CASE WHEN is_numeric THEN mx END, 6) AS max,
  CASE WHEN NOT is_numeric THEN k END AS cardinality
FROM facts""")
def c06_cli_metadata(spark, sf):
    m = TY.cli_metadata(_orders_x(spark, sf), ORD_COLS)
    return m.withColumn("min", r6("min")).withColumn("max", r6("max"))


def _deep(spark, sf):
    li = table(spark, sf, "lineitem")
    a = TY.deep_types(li, ["l_quantity", "l_linenumber"])
    b = TY.deep_types(table(spark, sf, "orders"), ["o_orderpriority"])
    c = TY.deep_types(table(spark, sf, "customer"), ["c_name"])
    d = TY.deep_types(table(spark, sf, "part").select(F.col("p_size").cast("string").alias("p_size_text")),
                      ["p_size_text"])
    return a.unionByName(b).unionByName(c).unionByName(d)


_DEEP_SQL = """
deep AS (
  SELECT 'l_quantity' AS feature, true AS is_numeric, 'DISCRETE_UNIFORM' AS deep_type
    FROM (SELECT count(DISTINCT l_quantity) AS u, min(l_quantity) lo, max(l_quantity) hi, bool_and(l_quantity = floor(l_quantity)) isint FROM lineitem)
    WHERE isint AND NOT ((u <= 12 AND lo >= 1 AND hi <= 12) OR (u <= 7 AND lo >= 0 AND hi <= 6) OR (u <= 24 AND lo >= 0 AND hi <= 23))
  UNION ALL
  SELECT 'l_linenumber', true, CASE WHEN (u <= 12 AND lo >= 1 AND hi <= 12) THEN 'CYCLIC' ELSE 'DISCRETE_UNIFORM' END
    FROM (SELECT count(DISTINCT l_linenumber) AS u, min(l_linenumber) lo, max(l_linenumber) hi FROM lineitem)
  UNION ALL
  SELECT 'o_orderpriority', false, CASE WHEN count(DISTINCT o_orderpriority) < 10 THEN 'CATEGORICAL_LOW_CARDINALITY'
    ELSE 'CATEGORICAL_HIGH_CARDINALITY' END FROM orders
  UNION ALL
  SELECT 'c_name', false, CASE WHEN count(DISTINCT c_name) < 10 THEN 'CATEGORICAL_LOW_CARDINALITY'
    ELSE 'CATEGORICAL_HIGH_CARDINALITY' END FROM customer
  UNION ALL
  SELECT 'p_size_text', false, CASE WHEN cv < 0.3 THEN 'ORDINAL' ELSE 'CATEGORICAL_LOW_CARDINALITY' END
    FROM (SELECT stddev_pop(g) / avg(g) AS cv FROM (SELECT lead(x) OVER (ORDER BY x) - x AS g
          FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) AS x FROM part)) WHERE g IS NOT NULL))"""


@query("c01_deep_types", f"WITH {_DEEP_SQL} SELECT * FROM deep")
def c01_deep_types(spark, sf):
    return _deep(spark, sf)


@query("c02_recommended_transform", f"""
WITH {_DEEP_SQL},
lut AS (SELECT * FROM (VALUES ('DISCRETE_UNIFORM', 'ordinal_encoding', '{{}}'), ('CYCLIC', 'sincos_encoding', '{{"period": 24}}'),
  ('CATEGORICAL_LOW_CARDINALITY', 'one_hot', '{{}}'), ('CATEGORICAL_HIGH_CARDINALITY', 'target_encoding', '{{"smoothing": 10}}'),
  ('ORDINAL', 'ordinal_encoding', '{{"mapping_strategy": "frequency"}}')) AS t(deep_type, transformation, parameters))
SELECT feature, deep_type, transformation, parameters FROM deep LEFT JOIN lut USING (deep_type)""")
def c02_recommended_transform(spark, sf):
    return TY.recommended_transform(_deep(spark, sf))


@query("c07_canonical_projection", f"""
WITH {_DEEP_SQL},
card AS (SELECT 'o_orderpriority' AS feature, count(DISTINCT o_orderpriority) AS k FROM orders
         UNION ALL SELECT 'c_name', count(DISTINCT c_name) FROM customer),
m AS (SELECT deep.feature, deep_type, card.k FROM deep LEFT JOIN card USING (feature))
SELECT feature,
  CASE WHEN deep_type IN ('DISCRETE_UNIFORM') THEN 'continuous' WHEN deep_type = 'CYCLIC' THEN 'datetime'
       ELSE 'categorical' END AS canonical_type,
  CAST(CASE WHEN deep_type = 'CYCLIC' THEN 1 WHEN deep_type = 'DISCRETE_UNIFORM' THEN NULL
       WHEN k > 1 THEN k ELSE 2 END AS INTEGER) AS output_dim,
  CAST(NULL AS INTEGER) AS n_modes
FROM m""")
def c07_canonical_projection(spark, sf):
    deep = _deep(spark, sf)
    o = table(spark, sf, "orders").agg(F.count_distinct("o_orderpriority").alias("k")) \
        .select(F.lit("o_orderpriority").alias("feature"), "k")
    c = table(spark, sf, "customer").agg(F.count_distinct("c_name").alias("k")).select(F.lit("c_name").alias("feature"), "k")
    card = o.unionByName(c)
    meta = deep.join(F.broadcast(card), "feature", "left").select(
        "feature", "deep_type", F.col("k").cast("int").alias("cardinality"))
    return TY.canonical_projection(meta)


@query("c08_metadata_checks", f"""
WITH {_ORD_X_SQL}, {_facts_sql('ox', ORD_COLS, _ORD_TYPES)},
m AS (SELECT feature, CASE WHEN is_numeric THEN 'continuous' WHEN feature = 'o_orderdate' THEN 'datetime' ELSE 'categorical' END AS type,
        CASE WHEN is_numeric THEN mx END AS mn, CASE WHEN is_numeric THEN mn END AS mx,
        CASE WHEN NOT is_numeric THEN k END AS cardinality FROM facts)
SELECT feature, type, type IN ('continuous','categorical','multimodal','datetime','ordinal','binary') AS type_supported,
  CASE WHEN type = 'categorical' THEN coalesce(cardinality > 0, false) ELSE true END AS cardinality_ok,
  round(least(mn, mx), 6) AS min, round(greatest(mn, mx), 6) AS max, mn > mx AS swapped
FROM m""")
def c08_metadata_checks(spark, sf):
    m = TY.cli_metadata(_orders_x(spark, sf), ORD_COLS)
    # reversed bounds injected: min and max swapped on purpose
    m = m.select("feature", F.when(F.col("feature") == "o_orderdate", F.lit("datetime")).otherwise(F.col("type")).alias("type"),
                 F.col("max").alias("min"), F.col("min").alias("max"), "cardinality")
    out = TY.validate_metadata(m)
    return out.withColumn("min", r6("min")).withColumn("max", r6("max"))


_RANK_SQL = """(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"""


@query("c09_spearman_strength", f"""
WITH r AS (SELECT {_RANK_SQL.format(c='l_quantity')} AS ra, {_RANK_SQL.format(c='l_extendedprice')} AS rb FROM lineitem)
SELECT 'l_quantity' AS col1, 'l_extendedprice' AS col2, round(abs(corr(ra, rb)), 6) AS score FROM r""")
def c09_spearman_strength(spark, sf):
    s = R.spearman_strength(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return s.withColumn("score", r6("score"))


def _li_x(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("qty_big", F.when(F.col("l_quantity") > 25, "Y").otherwise("N"))


_LI_X_SQL = "lx AS (SELECT *, CASE WHEN l_quantity > 25 THEN 'Y' ELSE 'N' END AS qty_big FROM lineitem)"


def _chi_sql(a, b, idx):
    return f"""
ct{idx} AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS VARCHAR) AS b, count(*) AS o FROM lx GROUP BY 1, 2),
ra{idx} AS (SELECT a, sum(o) AS ra FROM ct{idx} GROUP BY a), cb{idx} AS (SELECT b, sum(o) AS cb FROM ct{idx} GROUP BY b),
n{idx} AS (SELECT sum(o) AS n, count(DISTINCT a) AS r, count(DISTINCT b) AS c FROM ct{idx}),
cells{idx} AS (SELECT ra{idx}.a, cb{idx}.b, ra * cb / n AS e, coalesce(o, 0) AS o, n, r, c
  FROM ra{idx} CROSS JOIN cb{idx} CROSS JOIN n{idx} LEFT JOIN ct{idx} ON ct{idx}.a = ra{idx}.a AND ct{idx}.b = cb{idx}.b),
s{idx} AS (SELECT '{a}' AS col1, '{b}' AS col2, max(n) AS n, max(r) AS r, max(c) AS c, (max(r) - 1) * (max(c) - 1) AS dof,
  CASE WHEN (max(r) - 1) * (max(c) - 1) = 1 THEN sum(power(greatest(abs(o - e) - 0.5, 0), 2) / e)
       ELSE sum(power(o - e, 2) / e) END AS chi2 FROM cells{idx})"""


@query("c10_cramers_v", f"""
WITH {_LI_X_SQL}, {_chi_sql('l_returnflag', 'l_linestatus', 1)}, {_chi_sql('l_linestatus', 'qty_big', 2)},
s AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
p AS (SELECT *, CASE WHEN dof = 2 THEN exp(-chi2 / 2.0) WHEN dof = 1 THEN 2.0 * (1.0 - {phi_sql('sqrt(chi2)')}) END AS p_value,
        CASE WHEN least(r, c) - 1 > 0 THEN sqrt(chi2 / (n * (least(r, c) - 1))) ELSE 0 END AS v FROM s)
SELECT col1, col2, round(chi2, 6) AS chi2, CAST(dof AS BIGINT) AS dof, round(p_value, 6) AS p_value,
  round(v, 6) AS cramers_v, round(CASE WHEN p_value < 0.05 THEN v ELSE 0 END, 6) AS score FROM p""")
def c10_cramers_v(spark, sf):
    v = R.cramers_v(_li_x(spark, sf), [("l_returnflag", "l_linestatus"), ("l_linestatus", "qty_big")])
    return v.select("col1", "col2", r6("chi2").alias("chi2"), F.col("dof").cast("bigint").alias("dof"),
                    r6("p_value").alias("p_value"), r6("cramers_v").alias("cramers_v"), r6("score").alias("score"))


def _mi_sql(a, b, idx, bin_b=False):
    bexpr = (f"CAST(least(floor((CAST({b} AS DOUBLE) - (SELECT min({b}) FROM lineitem)) / "
             f"(((SELECT max({b}) FROM lineitem) - (SELECT min({b}) FROM lineitem)) / 20.0)), 19) AS BIGINT)"
             if bin_b else b)
    return f"""
m{idx}_ct AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({bexpr} AS VARCHAR) AS b, count(*) AS o FROM lineitem GROUP BY 1, 2),
m{idx}_ra AS (SELECT a, sum(o) AS ra FROM m{idx}_ct GROUP BY a), m{idx}_cb AS (SELECT b, sum(o) AS cb FROM m{idx}_ct GROUP BY b),
m{idx} AS (SELECT '{a}' AS col1, '{b}' AS col2, sum(o / n * ln(o * n / (ra * cb))) AS mi
  FROM m{idx}_ct JOIN m{idx}_ra USING (a) JOIN m{idx}_cb USING (b), (SELECT sum(o) AS n FROM m{idx}_ct))"""


@query("c11_mutual_information", f"""
WITH {_mi_sql('l_returnflag', 'l_linestatus', 1)}, {_mi_sql('l_returnflag', 'l_quantity', 2, True)},
     {_mi_sql('l_linestatus', 'l_discount', 3)}
SELECT col1, col2, round(mi, 6) AS mi, round(least(mi / 2.0, 1.0), 6) AS score
FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)""")
def c11_mutual_information(spark, sf):
    li = table(spark, sf, "lineitem")
    bins = R.equal_width_bins(li, ["l_quantity"])
    mi = R.mutual_information(li, [("l_returnflag", "l_linestatus"), ("l_returnflag", "l_quantity"),
                                   ("l_linestatus", "l_discount")], bins)
    return mi.select("col1", "col2", r6("mi").alias("mi"), r6(F.least(F.col("mi") / 2.0, F.lit(1.0))).alias("score"))


def knn_mi_sql(src: str, a: str, b: str, idx: int, k: int = 3) -> str:
    """CTEs ending in k{idx}(mi): nearest-neighbour MI of class ``a`` and number
    ``b``, row by row over windows."""
    dist = ", ".join(
        f"CASE WHEN i > {s} AND nc - i >= {k} - {s} THEN greatest("
        + (f"v - lag(v, {s}) OVER w" if s else "0.0") + ", " + (f"lead(v, {k - s}) OVER w - v" if k - s else "0.0") + ") END"
        for s in range(k + 1))
    return f"""
k{idx}_t AS (SELECT CAST({a} AS VARCHAR) AS a, CAST({b} AS DOUBLE) AS v,
  count(*) OVER (PARTITION BY {a}) AS nc, row_number() OVER (PARTITION BY {a} ORDER BY {b}) AS i
  FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL),
k{idx}_r AS (SELECT a, v, nc, least(nc - 1, {k}) AS kc,
  CASE WHEN nc > {k} THEN least({dist}) ELSE greatest(v - min(v) OVER (PARTITION BY a), max(v) OVER (PARTITION BY a) - v) END AS r
  FROM k{idx}_t WHERE nc > 1 WINDOW w AS (PARTITION BY a ORDER BY v)),
k{idx}_d AS (SELECT v, r, kc, nc, count(*) AS cnt FROM k{idx}_r GROUP BY ALL),
k{idx}_v AS (SELECT v AS u, count(*) AS c, sum(count(*)) OVER (ORDER BY v) AS upto FROM k{idx}_r GROUP BY v),
k{idx}_m AS (SELECT d.*, CASE WHEN r > 0 THEN
    coalesce(hi.upto, 0) - coalesce(lo.upto, 0) - CASE WHEN hi.u = v + r THEN hi.c ELSE 0 END ELSE own.c END AS m
  FROM k{idx}_d d ASOF LEFT JOIN k{idx}_v hi ON d.v + d.r >= hi.u ASOF LEFT JOIN k{idx}_v lo ON d.v - d.r >= lo.u
  JOIN k{idx}_v own ON own.u = d.v),
k{idx} AS (SELECT greatest(0.0, {digamma_sql("sum(cnt)")} + sum(cnt * ({digamma_sql("kc")} - {digamma_sql("nc")}
    - {digamma_sql("greatest(m, 1)")})) / sum(cnt)) AS mi FROM k{idx}_m)"""


@query("c11_neighbour_information", f"""
WITH {knn_mi_sql('orders', 'o_orderstatus', 'o_totalprice', 1)}, {knn_mi_sql('lineitem', 'l_returnflag', 'l_extendedprice', 2)},
     {knn_mi_sql('lineitem', 'l_linestatus', 'l_quantity', 3)}
SELECT 'o_orderstatus' AS col1, 'o_totalprice' AS col2, round(mi, 6) AS mi, round(least(mi / 2.0, 1.0), 6) AS score FROM k1
UNION ALL SELECT 'l_returnflag', 'l_extendedprice', round(mi, 6), round(least(mi / 2.0, 1.0), 6) FROM k2
UNION ALL SELECT 'l_linestatus', 'l_quantity', round(mi, 6), round(least(mi / 2.0, 1.0), 6) FROM k3""")
def c11_neighbour_information(spark, sf):
    li = table(spark, sf, "lineitem")
    mi = neighbour_information(table(spark, sf, "orders"), [("o_orderstatus", "o_totalprice")]).unionByName(
        neighbour_information(li, [("l_returnflag", "l_extendedprice"), ("l_linestatus", "l_quantity")]))
    return mi.select("col1", "col2", r6("mi").alias("mi"), r6(F.least(F.col("mi") / 2.0, F.lit(1.0))).alias("score"))


REL_COLS = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]

_REL_SQL = f"""
{knn_mi_sql('lineitem', 'l_returnflag', 'l_quantity', 1)}, {knn_mi_sql('lineitem', 'l_linestatus', 'l_quantity', 2)},
{knn_mi_sql('lineitem', 'l_returnflag', 'l_discount', 3)}, {knn_mi_sql('lineitem', 'l_linestatus', 'l_discount', 4)},
{_mi_sql('l_returnflag', 'l_linestatus', 5)},
rk AS (SELECT {_RANK_SQL.format(c='l_quantity')} AS ra, {_RANK_SQL.format(c='l_discount')} AS rb FROM lineitem),
half AS (
  SELECT 'l_quantity' AS col1, 'l_discount' AS col2, 'spearman' AS kind, abs(corr(ra, rb)) AS score FROM rk
  UNION ALL SELECT 'l_quantity', 'l_returnflag', 'mutual_info', least(mi / 2.0, 1.0) FROM k1
  UNION ALL SELECT 'l_quantity', 'l_linestatus', 'mutual_info', least(mi / 2.0, 1.0) FROM k2
  UNION ALL SELECT 'l_discount', 'l_returnflag', 'mutual_info', least(mi / 2.0, 1.0) FROM k3
  UNION ALL SELECT 'l_discount', 'l_linestatus', 'mutual_info', least(mi / 2.0, 1.0) FROM k4
  UNION ALL SELECT col1, col2, 'mutual_info', least(mi / 2.0, 1.0) FROM m5),
mat AS (SELECT * FROM half UNION ALL SELECT col2, col1, kind, score FROM half)"""


@query("c12_relationship_matrix", f"WITH {_REL_SQL} SELECT col1, col2, kind, round(score, 6) AS score FROM mat")
def c12_relationship_matrix(spark, sf):
    m = R.relationship_matrix(table(spark, sf, "lineitem"), REL_COLS)
    return m.withColumn("score", r6("score"))


@query("c13_dependency_dag", f"""
WITH {_REL_SQL},
infl AS (SELECT col1 AS col, sum(score) AS s FROM mat GROUP BY col1),
pos AS (SELECT col, row_number() OVER (ORDER BY s DESC, col ASC) AS p FROM infl)
SELECT col1 AS parent, col2 AS child, round(score, 6) AS strength
FROM mat JOIN pos p1 ON p1.col = mat.col1 JOIN pos p2 ON p2.col = mat.col2
WHERE p1.p < p2.p AND score > 0.15""")
def c13_dependency_dag(spark, sf):
    m = R.relationship_matrix(table(spark, sf, "lineitem"), REL_COLS)
    return R.dependency_dag(m, 0.15).withColumn("strength", r6("strength"))


@query("c14_prune_edges", f"""
WITH {_REL_SQL}
SELECT col1 AS parent, col2 AS child, round(score, 6) AS strength FROM mat
WHERE col1 IN ('l_quantity', 'l_returnflag', 'l_linestatus') AND col2 IN ('l_quantity', 'l_returnflag', 'l_linestatus')""")
def c14_prune_edges(spark, sf):
    m = R.relationship_matrix(table(spark, sf, "lineitem"), REL_COLS)
    edges = m.select(F.col("col1").alias("parent"), F.col("col2").alias("child"), F.col("score").alias("strength"))
    return R.prune_edges(edges, ["l_quantity", "l_returnflag", "l_linestatus", "l_shipmode"]) \
        .withColumn("strength", r6("strength"))


@query("c15_quantile_bins", """
WITH e AS (SELECT list_sort(list_distinct([quantile_cont(l_extendedprice, 0.0), quantile_cont(l_extendedprice, 0.2),
             quantile_cont(l_extendedprice, 0.4), quantile_cont(l_extendedprice, 0.6), quantile_cont(l_extendedprice, 0.8),
             quantile_cont(l_extendedprice, 1.0)])) AS edges FROM lineitem),
b AS (SELECT 'l_extendedprice_q' || CAST(len(list_filter(edges[2:len(edges) - 1], lambda x: x < l_extendedprice)) AS VARCHAR) AS l_extendedprice
      FROM lineitem, e)
SELECT l_extendedprice, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def c15_quantile_bins(spark, sf):
    b = R.quantile_bin(table(spark, sf, "lineitem").select("l_extendedprice"), ["l_extendedprice"], q=5)
    return b.groupBy("l_extendedprice").agg(F.count(F.lit(1)).alias("n"))


@query("c16_uniform_bins", """
WITH m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
e AS (SELECT [lo + (hi - lo) * 1 / 5, lo + (hi - lo) * 2 / 5, lo + (hi - lo) * 3 / 5, lo + (hi - lo) * 4 / 5] AS inn FROM m),
b AS (SELECT 'o_totalprice_b' || CAST(len(list_filter(inn, lambda x: x < o_totalprice)) AS VARCHAR) AS o_totalprice FROM orders, e)
SELECT o_totalprice, CAST(count(*) AS BIGINT) AS n FROM b GROUP BY 1""")
def c16_uniform_bins(spark, sf):
    b = R.uniform_bin(table(spark, sf, "orders").select("o_totalprice"), ["o_totalprice"], n_bins=5)
    return b.groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("n"))


@query("c17_class_imbalance", """
WITH c AS (SELECT toxic, count(*) AS cnt FROM labels GROUP BY toxic)
SELECT 'toxic' AS target, CAST(count(*) AS BIGINT) AS n_classes, CAST(arg_min(toxic, cnt) AS VARCHAR) AS minority,
  round(min(cnt) / sum(cnt), 6) AS minority_share, min(cnt) / sum(cnt) < 0.1 AS is_imbalanced FROM c""")
def c17_class_imbalance(spark, sf):
    ci = TY.class_imbalance(table(spark, sf, "labels"), "toxic")
    return ci.withColumn("minority_share", r6("minority_share"))
