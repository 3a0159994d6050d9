"""Flagship query: rule validation with a compliance rollup (E1, E5-E8,
E10, E11, E18) over ``customer``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabvet.operators.rules import RuleSet
from tabvet.plans.registry import query, r6
from tabvet.session import table

FLAGSHIP_RULES = [
    ("acctbal_nonneg", "c_acctbal >= 0", "CRITICAL"),
    ("acctbal_range", "c_acctbal BETWEEN -999 AND 9000", "HIGH"),
    ("segment_known", "c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')", "HIGH"),
    ("rich_or_local", "c_acctbal > 100 OR c_nationkey < 5", "MEDIUM"),
    ("building_min", "IF c_mktsegment == 'BUILDING' THEN c_acctbal >= 500", "MEDIUM"),
]


def compliance_rollup(counts, severity):
    """Per-rule counts joined to the rule catalog, rolled up by
    severity (NULL severity = all rules)."""
    j = counts.join(F.broadcast(severity), "rule")
    checked = F.col("violations") + F.col("satisfied")
    out = (j.rollup("severity")
           .agg(F.count(F.lit(1)).alias("rules"),
                F.sum(checked).alias("checked"),
                F.sum("violations").alias("violations")))
    rate = (F.col("checked") - F.col("violations")) / F.greatest(F.col("checked"), F.lit(1)) * 100.0
    return out.select("severity", "rules", "checked", "violations",
                      r6(rate, 4).alias("compliance_pct"))


def flagship(spark, sf):
    cust = table(spark, sf, "customer")
    rs = RuleSet([(n, r) for n, r, _ in FLAGSHIP_RULES])
    counts = rs.violation_counts(cust)
    sev = spark.createDataFrame([(n, s) for n, _, s in FLAGSHIP_RULES], "rule string, severity string")
    return compliance_rollup(counts, sev)


_FLAG_SQL = """
WITH v AS (
  SELECT coalesce(c_acctbal >= 0, false) AS acctbal_nonneg,
         coalesce(c_acctbal BETWEEN -999 AND 9000, false) AS acctbal_range,
         coalesce(c_mktsegment IN ('BUILDING','AUTOMOBILE','MACHINERY','HOUSEHOLD'), false) AS segment_known,
         (coalesce(c_acctbal > 100, false) OR coalesce(c_nationkey < 5, false)) AS rich_or_local,
         CASE WHEN coalesce(c_mktsegment = 'BUILDING', false) THEN coalesce(c_acctbal >= 500, false) ELSE true END AS building_min
  FROM customer),
long AS (
  SELECT 'CRITICAL' AS severity, acctbal_nonneg AS ok FROM v UNION ALL
  SELECT 'HIGH', acctbal_range FROM v UNION ALL
  SELECT 'HIGH', segment_known FROM v UNION ALL
  SELECT 'MEDIUM', rich_or_local FROM v UNION ALL
  SELECT 'MEDIUM', building_min FROM v),
per AS (
  SELECT severity, CAST(count(*) AS BIGINT) AS checked, CAST(count_if(NOT ok) AS BIGINT) AS violations
  FROM long GROUP BY severity),
nrules AS (SELECT * FROM (VALUES ('CRITICAL', 1), ('HIGH', 2), ('MEDIUM', 2)) AS t(severity, rules)),
agg AS (
  SELECT p.severity, CAST(sum(n.rules) AS BIGINT) AS rules, CAST(sum(checked) AS BIGINT) AS checked,
         CAST(sum(violations) AS BIGINT) AS violations
  FROM per p JOIN nrules n USING (severity) GROUP BY ROLLUP (p.severity))
SELECT severity, rules, checked, violations,
  round(CAST(checked - violations AS DOUBLE) / greatest(checked, 1) * 100.0, 4) AS compliance_pct
FROM agg"""


@query("e18_compliance_report", _FLAG_SQL)
def e18_compliance_report(spark, sf):
    return flagship(spark, sf)
