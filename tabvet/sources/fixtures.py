"""Derived inputs built from the driver's tables (FIXTURES.md §3).

Each fixture is a Spark transformation of a given table, so its size
grows with the data; the matching DuckDB text lives next to it so that
oracle queries derive exactly the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.session import table


def customer_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer with injected NULLs: balance on every 10th key, segment on
    every 7th key."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).otherwise(F.col("c_acctbal")).alias("c_acctbal"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))


CUSTOMER_NULLS_SQL = """customer_n AS (
  SELECT c_custkey, c_name, c_nationkey,
         CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""
