"""Rule catalog, table-level rules and per-operator rule queries
(SURVEY 2.E: E1, E2, E5-E9, E16, E17, E19-E26)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabvet.operators import integrity as I
from tabvet.operators.rules import RuleSet
from tabvet.plans.flagship import compliance_rollup
from tabvet.plans.q_rules import AS_OF, CUSTOMER_RULES, _V
from tabvet.plans.registry import query, r6
from tabvet.session import table
from tabvet.sources.fixtures import CUSTOMER_NULLS_SQL, customer_nulls
from tabvet.sources.rule_catalog import CATALOG, catalog_table

# --- one query per rule-language operator ----------------------------------

_SUBSETS = {
    "e01_cmp_numeric": ["bal_nonneg", "arith"],
    "e02_cmp_text": ["text_order", "text_ne"],
    "e05_between": ["bal_range"],
    "e06_membership": ["seg_in", "seg_not_in", "nation_in"],
    "e07_logical_chain": ["chain_and_or", "chain_xor", "infix_not", "nested"],
    "e08_conditional": ["if_then"],
    "e09_missing_column": ["missing_col", "col_vs_col"],
}


def _subset_query(qname, names):
    sql = f"""WITH {CUSTOMER_NULLS_SQL}
SELECT c_custkey, {', '.join(f'{_V[n]} AS VALID_{n}' for n in names)} FROM customer_n"""

    @query(qname, sql)
    def _q(spark, sf):
        rs = RuleSet([r for r in CUSTOMER_RULES if r[0] in names], as_of=AS_OF)
        return rs.validate(customer_nulls(spark, sf)).select("c_custkey", *[f"VALID_{n}" for n in names])
    return _q


for _qn, _names in _SUBSETS.items():
    _subset_query(_qn, _names)


# --- E16-E18: the catalog applied to a banking view of customer --------------

def bank_view(spark, sf):
    c = table(spark, sf, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("customer_id"),
        (F.lit(10) + F.col("c_nationkey") * 4).alias("age"),
        F.col("c_acctbal").alias("balance"),
        F.when(seg == "BUILDING", "savings").when(seg == "AUTOMOBILE", "checking")
        .when(seg == "MACHINERY", "business").when(seg == "HOUSEHOLD", "cd").otherwise("loan").alias("account_type"),
        (F.lit(300) + (F.col("c_custkey") * 37) % 600).alias("credit_score"),
        F.date_add(F.lit("1990-01-01").cast("date"), ((F.col("c_custkey") * 7) % 4000).cast("int"))
        .alias("account_creation_date"))


_BANK_SQL = """bank AS (
  SELECT c_custkey AS customer_id, 10 + c_nationkey * 4 AS age, c_acctbal AS balance,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'savings' WHEN 'AUTOMOBILE' THEN 'checking' WHEN 'MACHINERY' THEN 'business'
      WHEN 'HOUSEHOLD' THEN 'cd' ELSE 'loan' END AS account_type,
    300 + (c_custkey * 37) % 600 AS credit_score,
    DATE '1990-01-01' + CAST((c_custkey * 7) % 4000 AS INTEGER) AS account_creation_date
  FROM customer)"""

# oracle verdicts of the catalog rules that apply to the banking view
_BANK_V = {
    "customer_age": "coalesce(age >= 18, false) AND coalesce(age <= 120, false)",
    "account_balance": "coalesce(balance >= 0, false)",
    "minimum_balance_savings": "CASE WHEN coalesce(account_type = 'savings', false) THEN coalesce(balance >= 100, false) ELSE true END",
    "account_type_classification": "coalesce(account_type IN ('savings','checking','money_market','cd','ira','brokerage','business_checking'), false)",
    "credit_score_range": "coalesce(credit_score >= 300, false) AND coalesce(credit_score <= 850, false)",
    "credit_score_by_age": "CASE WHEN coalesce(age < 21, false) THEN (coalesce(credit_score <= 750, false) OR credit_score IS NULL) ELSE true END",
    "business_account_age": "CASE WHEN coalesce(account_type = 'business', false) THEN coalesce(age >= 18, false) ELSE true END",
    "account_creation_temporal": f"coalesce(account_creation_date <= TIMESTAMP '{AS_OF} 00:00:00', false)",
    "patient_age": "coalesce(age >= 0, false) AND coalesce(age <= 120, false)",
}


def _catalog_counts_sql(domains: list[str]) -> str:
    rows = [r for r in CATALOG if r[0] in domains]
    longs = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {_BANK_V.get(name, 'CAST(NULL AS BOOLEAN)')} AS v FROM bank"
        for _, name, *_ in rows)
    return f"""{_BANK_SQL},
long AS ({longs}),
counts AS (SELECT rule, CAST(count(*) FILTER (WHERE v = false) AS BIGINT) AS violations,
  CAST(count(*) FILTER (WHERE v = true) AS BIGINT) AS satisfied,
  CAST(count(*) FILTER (WHERE v IS NULL) AS BIGINT) AS not_applicable FROM long GROUP BY rule),
cat AS (SELECT * FROM (VALUES {', '.join(f"('{n}', '{d}', '{s}', '{lv}')" for d, n, _, s, lv, _ in rows)})
        AS t(rule, domain, severity, level))"""


def _catalog_rules(spark, domain=None):
    cat = catalog_table(spark)
    if domain:
        cat = cat.filter(F.col("domain") == domain)
    return cat


def _catalog_counts(spark, sf, domain=None):
    cat = _catalog_rules(spark, domain)
    rs = RuleSet([(r["name"], r["rule"]) for r in cat.select("name", "rule").collect()], as_of=AS_OF)
    counts = rs.violation_counts(bank_view(spark, sf))
    meta = cat.select(F.col("name").alias("rule"), "domain", "severity", "level")
    return counts.join(F.broadcast(meta), "rule")


@query("e16_rule_catalog", f"""
WITH {_catalog_counts_sql(['financial', 'healthcare', 'enterprise'])}
SELECT rule, domain, severity, level, violations, satisfied, not_applicable FROM counts JOIN cat USING (rule)""")
def e16_rule_catalog(spark, sf):
    return _catalog_counts(spark, sf).select("rule", "domain", "severity", "level", "violations", "satisfied",
                                             "not_applicable")


@query("e17_catalog_domain_validation", f"""
WITH {_catalog_counts_sql(['financial'])}
SELECT rule, violations, satisfied, not_applicable FROM counts""")
def e17_catalog_domain_validation(spark, sf):
    return _catalog_counts(spark, sf, "financial").select("rule", "violations", "satisfied", "not_applicable")


@query("e18_catalog_compliance", f"""
WITH {_catalog_counts_sql(['financial', 'healthcare', 'enterprise'])},
j AS (SELECT * FROM counts JOIN cat USING (rule)),
agg AS (SELECT severity, CAST(count(*) AS BIGINT) AS rules, CAST(sum(violations + satisfied) AS BIGINT) AS checked,
          CAST(sum(violations) AS BIGINT) AS violations FROM j GROUP BY ROLLUP (severity))
SELECT severity, rules, checked, violations,
  round(CAST(checked - violations AS DOUBLE) / greatest(checked, 1) * 100.0, 4) AS compliance_pct FROM agg""")
def e18_catalog_compliance(spark, sf):
    j = _catalog_counts(spark, sf)
    return compliance_rollup(j.select("rule", "violations", "satisfied"), j.select("rule", "severity"))


# --- E19-E21 -------------------------------------------------------------------

@query("e19_completeness", f"""
WITH {CUSTOMER_NULLS_SQL}
SELECT 'c_custkey' AS "column", true AS present, CAST(count(*) FILTER (WHERE c_custkey IS NULL) AS BIGINT) AS nulls,
  count(*) FILTER (WHERE c_custkey IS NULL) = 0 AS valid FROM customer_n
UNION ALL SELECT 'c_acctbal', true, CAST(count(*) FILTER (WHERE c_acctbal IS NULL) AS BIGINT),
  count(*) FILTER (WHERE c_acctbal IS NULL) = 0 FROM customer_n
UNION ALL SELECT 'c_mktsegment', true, CAST(count(*) FILTER (WHERE c_mktsegment IS NULL) AS BIGINT),
  count(*) FILTER (WHERE c_mktsegment IS NULL) = 0 FROM customer_n
UNION ALL SELECT 'account_id', false, CAST(NULL AS BIGINT), false""")
def e19_completeness(spark, sf):
    return I.completeness(customer_nulls(spark, sf), ["c_custkey", "c_acctbal", "c_mktsegment", "account_id"])


@query("e20_referential_integrity", """
SELECT l_orderkey, CAST(count(*) AS BIGINT) AS orphan_lines FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 100 <> 0)
GROUP BY l_orderkey""")
def e20_referential_integrity(spark, sf):
    parent = table(spark, sf, "orders").filter(F.col("o_orderkey") % 100 != 0)
    orphans = I.referential_orphans(table(spark, sf, "lineitem"), parent, "l_orderkey", "o_orderkey")
    return orphans.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("orphan_lines"))


@query("e21_version_monotonic", """
WITH v AS (SELECT event_id, user_id, CAST(floor(value) AS BIGINT) AS record_version,
  lag(CAST(floor(value) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY event_id) AS previous_version FROM events)
SELECT event_id, user_id, record_version, previous_version,
  CASE WHEN previous_version IS NULL THEN true ELSE record_version >= previous_version END AS VALID_version_control FROM v""")
def e21_version_monotonic(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.floor("value").alias("record_version"))
    return I.version_monotonic(e, ["user_id"], ["event_id"], "record_version").select(
        "event_id", "user_id", "record_version", "previous_version", "VALID_version_control")


# --- E22: grammar extensions ---------------------------------------------------

GRAMMAR_RULES = [
    ("null_check", "o_comment IS NULL OR o_totalprice IS NOT NULL"),
    ("like_rule", "o_orderpriority LIKE '1-%'"),
    ("arith_rule", "o_totalprice / 1000 + 5 >= 100"),
    ("date_plus", "o_orderdate <= DATE'1995-01-01' + 1000"),
    ("nested_parens", "((o_totalprice > 100000) OR (o_orderstatus = 'F')) AND (o_custkey < 500)"),
    ("bool_literal", "IF o_totalprice > 400000 THEN is_big = True"),
]


@query("e22_grammar_extensions", f"""
WITH o AS (SELECT *, o_totalprice > 450000 AS is_big FROM orders)
SELECT o_orderkey,
  CAST(NULL AS BOOLEAN) AS VALID_null_check,
  coalesce(o_orderpriority LIKE '1-%', false) AS VALID_like_rule,
  coalesce(o_totalprice / 1000 + 5 >= 100, false) AS VALID_arith_rule,
  coalesce(o_orderdate <= DATE '1995-01-01' + 1000, false) AS VALID_date_plus,
  coalesce(o_totalprice > 100000 OR o_orderstatus = 'F', false) AND coalesce(o_custkey < 500, false) AS VALID_nested_parens,
  CASE WHEN coalesce(o_totalprice > 400000, false) THEN coalesce(is_big = true, false) ELSE true END AS VALID_bool_literal
FROM o""")
def e22_grammar_extensions(spark, sf):
    o = table(spark, sf, "orders").withColumn("is_big", F.col("o_totalprice") > 450000)
    out = RuleSet(GRAMMAR_RULES, as_of=AS_OF).validate(o)
    return out.select("o_orderkey", *[f"VALID_{n}" for n, _ in GRAMMAR_RULES])


# --- E23 / E26: hard and soft rules, user functions ----------------------------

def _hard_soft():
    hs = I.HardSoftRules()
    hs.add_rule("price_positive", lambda d: F.col("o_totalprice") > 0, ["o_totalprice"])
    hs.add_rule("known_status", "o_orderstatus IN ('F', 'O')", ["o_orderstatus"])
    hs.add_rule("needs_absent", lambda d: F.col("o_discount") > 0, ["o_discount"])
    hs.add_rule("price_score", lambda d: F.least(F.col("o_totalprice") / 500000.0, F.lit(1.0)), ["o_totalprice"],
                rule_type="soft", weight=2.0)
    hs.add_rule("urgent_score", lambda d: (F.col("o_orderpriority") == "1-URGENT").cast("double"), ["o_orderpriority"],
                rule_type="soft", weight=1.0)
    return hs


@query("e23_hard_soft_rules", """
SELECT o_orderkey,
  list_filter([CASE WHEN NOT coalesce(o_totalprice > 0, false) THEN 'price_positive' END,
               CASE WHEN NOT coalesce(o_orderstatus IN ('F', 'O'), false) THEN 'known_status' END], lambda x: x IS NOT NULL) AS violations,
  round((2.0 * least(o_totalprice / 500000.0, 1.0) + 1.0 * CAST(o_orderpriority = '1-URGENT' AS DOUBLE)) / 3.0, 6) AS soft_score
FROM orders""")
def e23_hard_soft_rules(spark, sf):
    out = _hard_soft().check(table(spark, sf, "orders"))
    return out.select("o_orderkey", "violations", r6("soft_score").alias("soft_score"))


def _discount_ok(disc):
    return (disc >= 0) & (disc <= 0.1)


@query("e26_user_rule_functions", """
SELECT l_orderkey, l_linenumber, l_discount >= 0 AND l_discount <= 0.1 AS VALID_discount_ok,
  coalesce(l_tax < l_discount * 2, false) AS VALID_tax_vs_discount FROM lineitem""")
def e26_user_rule_functions(spark, sf):
    li = table(spark, sf, "lineitem")

    def tax_rule(tax: pd.Series, disc: pd.Series) -> pd.Series:
        return (tax < disc * 2).fillna(False)

    # a Column-returning user function (default) and a vectorised pandas UDF
    udf = F.pandas_udf(tax_rule, "boolean")
    return li.select("l_orderkey", "l_linenumber", _discount_ok(F.col("l_discount")).alias("VALID_discount_ok"),
                     udf("l_tax", "l_discount").alias("VALID_tax_vs_discount"))


# --- E24 / E25: schema validation ---------------------------------------------

ORDER_SCHEMA = [
    I.ColumnSchema("o_orderkey", "continuous", nullable=False, min_value=0),
    I.ColumnSchema("o_totalprice", "continuous", nullable=False, min_value=1000.0, max_value=400000.0),
    I.ColumnSchema("o_orderstatus", "categorical", categories=["F", "O"]),
    I.ColumnSchema("o_orderpriority", "categorical", nullable=True),
]


@query("e24_schema_validation", """
SELECT "column", row_key, value FROM (
  SELECT 'o_totalprice' AS "column", CAST(o_orderkey AS VARCHAR) AS row_key, CAST(o_totalprice AS VARCHAR) AS value
    FROM orders WHERE NOT (o_totalprice >= 1000.0 AND o_totalprice <= 400000.0)
  UNION ALL
  SELECT 'o_orderstatus', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'O'))""")
def e24_schema_validation(spark, sf):
    o = table(spark, sf, "orders")
    return I.schema_errors(o, ORDER_SCHEMA, "o_orderkey")


@query("e25_unschematised_columns", """
SELECT "column", nulls FROM (
  SELECT 'o_custkey' AS "column", CAST(count(*) FILTER (WHERE o_custkey IS NULL) AS BIGINT) AS nulls FROM orders
  UNION ALL SELECT 'o_orderdate', CAST(count(*) FILTER (WHERE o_orderdate IS NULL) AS BIGINT) FROM orders)""")
def e25_unschematised_columns(spark, sf):
    o = table(spark, sf, "orders")
    extra = I.unschematised_columns(o, ORDER_SCHEMA)
    names = [r["column"] for r in extra.collect()]
    nulls = I.completeness(o, names).select("column", "nulls")
    return nulls.join(F.broadcast(extra), "column")
