"""Rule-validation queries over customer / orders / lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators.rules import RuleSet
from tabvet.plans.registry import query, r6
from tabvet.session import table
from tabvet.sources.fixtures import CUSTOMER_NULLS_SQL, customer_nulls

AS_OF = "1998-08-02"

CUSTOMER_RULES = [
    ("bal_nonneg", "c_acctbal >= 0"),
    ("bal_range", "c_acctbal BETWEEN -500 AND 9000"),
    ("seg_in", "c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')"),
    ("seg_not_in", "c_mktsegment NOT IN ('HOUSEHOLD')"),
    ("nation_in", "c_nationkey IN (1, 3, 5.0, 7)"),
    ("chain_and_or", "c_acctbal > 1000 AND c_nationkey < 10 OR c_mktsegment = 'FURNITURE'"),
    ("chain_xor", "c_acctbal < 0 XOR c_nationkey >= 12"),
    ("infix_not", "c_nationkey > 3 NOT c_acctbal > 5000"),
    ("if_then", "IF c_mktsegment == 'BUILDING' THEN c_acctbal >= 500"),
    ("missing_col", "c_creditlimit > 0"),
    ("col_vs_col", "c_acctbal > c_nationkey"),
    ("text_order", "c_mktsegment > 'A'"),
    ("text_ne", "c_mktsegment != 'BUILDING'"),
    ("not_null", "c_acctbal IS NOT NULL"),
    ("like", "c_name LIKE 'Customer#00000001%'"),
    ("arith", "c_acctbal * 2 + c_nationkey <= 15000"),
    ("nested", "(c_acctbal < 100 OR c_acctbal > 9000) AND c_nationkey IN (2, 4)"),
    ("bad_rule", "c_acctbal ~~ 5"),
]

# Oracle text of each verdict over customer_n (CASE form of the T3 rules).
_V = {
    "bal_nonneg": "coalesce(c_acctbal >= 0, false)",
    "bal_range": "coalesce(c_acctbal BETWEEN -500 AND 9000, false)",
    "seg_in": "coalesce(c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY'), false)",
    "seg_not_in": "NOT coalesce(c_mktsegment IN ('HOUSEHOLD'), false)",
    "nation_in": "coalesce(CAST(c_nationkey AS DOUBLE) IN (1, 3, 5, 7), false)",
    "chain_and_or": "((coalesce(c_acctbal > 1000, false) AND coalesce(c_nationkey < 10, false))"
                    " OR coalesce(c_mktsegment = 'FURNITURE', false))",
    "chain_xor": "(coalesce(c_acctbal < 0, false) <> coalesce(c_nationkey >= 12, false))",
    "infix_not": "NOT coalesce(c_acctbal > 5000, false)",
    "if_then": "CASE WHEN coalesce(c_mktsegment = 'BUILDING', false) THEN coalesce(c_acctbal >= 500, false) ELSE true END",
    "missing_col": "CAST(NULL AS BOOLEAN)",
    "col_vs_col": "CASE WHEN c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL THEN c_acctbal > c_nationkey ELSE false END",
    "text_order": "false",
    "text_ne": "coalesce(c_mktsegment <> 'BUILDING', false)",
    "not_null": "(c_acctbal IS NOT NULL)",
    "like": "coalesce(c_name LIKE 'Customer#00000001%', false)",
    "arith": "coalesce(c_acctbal * 2 + c_nationkey <= 15000, false)",
    "nested": "(coalesce(c_acctbal < 100 OR c_acctbal > 9000, false) AND coalesce(c_nationkey IN (2, 4), false))",
    "bad_rule": "CAST(NULL AS BOOLEAN)",
}


def _customer_rules():
    return RuleSet(CUSTOMER_RULES, as_of=AS_OF)


def _valid_cols_sql():
    return ",\n  ".join(f"{_V[n]} AS VALID_{n}" for n, _ in CUSTOMER_RULES)


@query("e10_validate_customer", f"""
WITH {CUSTOMER_NULLS_SQL}
SELECT c_custkey,
  {_valid_cols_sql()}
FROM customer_n""")
def e10_validate_customer(spark, sf):
    df = customer_nulls(spark, sf)
    return _customer_rules().validate(df).drop("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


def _long_sql():
    return " UNION ALL ".join(
        f"SELECT '{n}' AS rule, {i} AS position, VALID_{n} AS v FROM validated"
        for i, (n, _) in enumerate(CUSTOMER_RULES))


@query("e11_violation_counts", f"""
WITH {CUSTOMER_NULLS_SQL},
validated AS (SELECT c_custkey, {_valid_cols_sql()} FROM customer_n),
long AS ({_long_sql()})
SELECT rule, position,
  CAST(count(*) FILTER (WHERE v = false) AS BIGINT) AS violations,
  CAST(count(*) FILTER (WHERE v = true) AS BIGINT) AS satisfied,
  CAST(count_if(v IS NULL) AS BIGINT) AS not_applicable
FROM long GROUP BY rule, position""")
def e11_violation_counts(spark, sf):
    return _customer_rules().violation_counts(customer_nulls(spark, sf))


@query("e12_violation_examples", f"""
WITH {CUSTOMER_NULLS_SQL},
validated AS (SELECT c_custkey, {_valid_cols_sql()} FROM customer_n),
long AS ({_long_sql().replace('AS v FROM', 'AS v, c_custkey FROM')}),
ranked AS (SELECT rule, c_custkey, row_number() OVER (PARTITION BY rule ORDER BY c_custkey) AS example
           FROM long WHERE v = false)
SELECT rule, CAST(example AS INTEGER) AS example, c_custkey FROM ranked WHERE example <= 3""")
def e12_violation_examples(spark, sf):
    ex = _customer_rules().violation_examples(customer_nulls(spark, sf), key="c_custkey", n=3)
    return ex.select("rule", "example", "c_custkey")


@query("e13_mask_filter", f"""
WITH {CUSTOMER_NULLS_SQL},
validated AS (SELECT c_custkey, {_valid_cols_sql()} FROM customer_n)
SELECT c_custkey FROM validated WHERE
  {' AND '.join(f'coalesce(VALID_{n}, true)' for n in ('bal_nonneg', 'seg_not_in', 'if_then', 'missing_col'))}""")
def e13_mask_filter(spark, sf):
    rs = RuleSet([r for r in CUSTOMER_RULES if r[0] in ("bal_nonneg", "seg_not_in", "if_then", "missing_col")],
                 as_of=AS_OF)
    return rs.filter_valid(customer_nulls(spark, sf)).select("c_custkey")


@query("e14_valid_totals", f"""
WITH {CUSTOMER_NULLS_SQL},
validated AS (SELECT c_custkey, {_valid_cols_sql()} FROM customer_n),
m AS (SELECT {' AND '.join(f'coalesce(VALID_{n}, true)' for n, _ in CUSTOMER_RULES)} AS ok FROM validated)
SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count_if(ok) AS BIGINT) AS valid_rows,
       CAST(count_if(NOT ok) AS BIGINT) AS invalid_rows FROM m""")
def e14_valid_totals(spark, sf):
    return _customer_rules().totals(customer_nulls(spark, sf))


ORDER_ENFORCE_RULES = [
    ("p_range", "o_totalprice BETWEEN 5000 AND 450000"),
    ("p_min", "o_totalprice > 20000"),
    ("p_max", "o_totalprice < 400000"),
    ("p_ne", "o_totalprice != 5"),
    ("status", "o_orderstatus IN ('F')"),
    ("p_eq_far", "o_custkey = 7"),
]


@query("e15_enforce_orders", """
SELECT o_orderkey, o_orderstatus,
  round(least(greatest(least(greatest(o_totalprice, 5000.0), 450000.0), CAST(20000.000000001 AS DOUBLE)), CAST(399999.999999999 AS DOUBLE)), 6) AS o_totalprice,
  CAST(7 AS DOUBLE) AS o_custkey
FROM orders""")
def e15_enforce_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey")
    out = RuleSet(ORDER_ENFORCE_RULES).enforce(o)
    return out.select("o_orderkey", "o_orderstatus", r6("o_totalprice").alias("o_totalprice"), "o_custkey")


ORDER_RULES = [
    ("status_known", "o_orderstatus IN ('F', 'O')"),
    ("urgent_price", "IF o_orderpriority == '1-URGENT' THEN o_totalprice >= 100000"),
    ("positive_price", "o_totalprice > 0"),
    ("past_order", "o_orderdate <= current_date"),
    ("absent_rule", "o_discount_code = 'X'"),
]


@query("e04_date_const_orders", f"""
SELECT o_orderkey,
  coalesce(o_orderdate <= TIMESTAMP '{AS_OF} 00:00:00', false) AS VALID_past_order,
  coalesce(o_orderdate > TIMESTAMP '{AS_OF} 00:00:00', false) AS VALID_future_order
FROM orders""")
def e04_date_const_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    rs = RuleSet([("past_order", "o_orderdate <= current_date"),
                  ("future_order", "o_orderdate > today")], as_of=AS_OF)
    return rs.validate(o).drop("o_orderdate")


@query("e03_column_compare_lineitem", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  coalesce(l_quantity > l_discount * 100, false) AS VALID_qty_vs_disc,
  coalesce(l_partkey >= l_suppkey, false) AS VALID_part_ge_supp,
  coalesce(l_returnflag = l_linestatus, false) AS VALID_flag_eq_status,
  coalesce(l_returnflag <> l_linestatus, true) AS VALID_flag_ne_status,
  false AS VALID_flag_order
FROM lineitem""")
def e03_column_compare_lineitem(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("disc100", F.col("l_discount") * 100)
    rs = RuleSet([("qty_vs_disc", "l_quantity > disc100"),
                  ("part_ge_supp", "l_partkey >= l_suppkey"),
                  ("flag_eq_status", "l_returnflag = l_linestatus"),
                  ("flag_ne_status", "l_returnflag != l_linestatus"),
                  ("flag_order", "l_returnflag > l_linestatus")])
    out = rs.validate(li)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      *[c for c in out.columns if c.startswith("VALID_")])


@query("e11_order_rule_counts", f"""
WITH v AS (
  SELECT coalesce(o_orderstatus IN ('F','O'), false) AS status_known,
    CASE WHEN coalesce(o_orderpriority = '1-URGENT', false) THEN coalesce(o_totalprice >= 100000, false) ELSE true END AS urgent_price,
    coalesce(o_totalprice > 0, false) AS positive_price,
    coalesce(o_orderdate <= TIMESTAMP '{AS_OF} 00:00:00', false) AS past_order,
    CAST(NULL AS BOOLEAN) AS absent_rule
  FROM orders),
long AS (
  SELECT 'status_known' AS rule, 0 AS position, status_known AS v FROM v UNION ALL
  SELECT 'urgent_price', 1, urgent_price FROM v UNION ALL
  SELECT 'positive_price', 2, positive_price FROM v UNION ALL
  SELECT 'past_order', 3, past_order FROM v UNION ALL
  SELECT 'absent_rule', 4, absent_rule FROM v)
SELECT rule, position, CAST(count(*) FILTER (WHERE v = false) AS BIGINT) AS violations,
  CAST(count(*) FILTER (WHERE v = true) AS BIGINT) AS satisfied, CAST(count_if(v IS NULL) AS BIGINT) AS not_applicable
FROM long GROUP BY rule, position""")
def e11_order_rule_counts(spark, sf):
    return RuleSet(ORDER_RULES, as_of=AS_OF).violation_counts(table(spark, sf, "orders"))


@query("e27_rule_diagnostics", f"""
WITH {CUSTOMER_NULLS_SQL},
validated AS (SELECT c_custkey, {_valid_cols_sql()} FROM customer_n),
long AS ({_long_sql()})
SELECT rule, CASE WHEN rule = 'bad_rule' THEN 'error' ELSE 'ok' END AS status,
  CAST(count_if(v IS NULL) AS BIGINT) AS not_applicable
FROM long GROUP BY rule""")
def e27_rule_diagnostics(spark, sf):
    df = customer_nulls(spark, sf)
    rs = _customer_rules()
    diag = rs.diagnostics(spark, df).select("rule", "status")
    counts = rs.violation_counts(df).select("rule", "not_applicable")
    # both sides hold one row per rule
    return counts.join(F.broadcast(diag), "rule").select("rule", "status", "not_applicable")
