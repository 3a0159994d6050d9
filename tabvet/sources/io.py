"""Sources and sinks.

Readers and writers are the DataFrame API's; scratch output goes under
the shared checkpoint folder the session names (``spark.checkpoint.dir``),
never a machine-local temporary folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.functions.hashing import hu
from tabvet.session import checkpoint_dir


class UnsupportedFormat(ValueError):
    pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabvet-io/{name}-{uuid.uuid4().hex[:12]}"


def load_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A1: CSV with header and a fixed separator (';' by default)."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def sniff_separator(spark: SparkSession, path: str) -> str:
    """A2: ';' if it occurs in the header line, else ','.  Only the first
    line is read (a limit on a text scan)."""
    first = spark.read.text(path).limit(1).collect()
    return ";" if first and ";" in first[0]["value"] else ","


def load_csv_sniffed(spark: SparkSession, path: str) -> DataFrame:
    return load_csv(spark, path, sniff_separator(spark, path))


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """A3: Parquet by suffix (also CSV via A2); other suffixes rejected."""
    p = path.rstrip("/")
    if p.endswith(".parquet"):
        return spark.read.parquet(path)
    if p.endswith(".csv"):
        return load_csv_sniffed(spark, path)
    raise UnsupportedFormat(f"unsupported data format: {path}")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """A4: exactly n rows (when the table is larger) chosen by hash order of
    (seed, key): a top-n, reproducible sample (the limit is the feature)."""
    return df.withColumn("_h", hu(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def first_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The first n rows in key order (top-n)."""
    return df.orderBy(key).limit(n)


def train_test_split(df: DataFrame, key: str, test_size: float = 0.3, seed: int = 42) -> DataFrame:
    """Adds ``is_test`` = HU(seed, key) < test_size, so the split is a
    pure function of the key (stable under re-execution)."""
    return df.withColumn("is_test", hu(seed, key) < F.lit(test_size))


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """A5: rules from JSON ({name: rule}) or text ('name: rule' lines, '#'
    comments and blank lines skipped; split at the first colon)."""
    if path.rstrip("/").endswith(".json"):
        raw = spark.read.text(path, wholetext=True)
        m = raw.select(F.from_json("value", "map<string,string>").alias("m"))
        return m.select(F.explode("m").alias("name", "rule"))
    from tabvet.operators.rules import rule_text_lines
    return rule_text_lines(spark.read.text(path))


def save_rules(ruleset, counts: DataFrame, path: str) -> None:
    """Rule table (name, raw text, parsed tree, violation count) as JSON."""
    spark = counts.sparkSession
    meta = spark.createDataFrame([(r.name, r.text, json.dumps(r.tree) if r.tree is not None else None)
                                  for r in ruleset.rules], "rule string, raw string, parsed string")
    out = meta.join(counts.select("rule", "violations"), "rule", "left")
    out.write.mode("overwrite").json(path)


def load_rule_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("rule string, raw string, parsed string, violations long").json(path)


def save_schema(schema: DataFrame, path: str) -> None:
    """Schema table as JSON."""
    schema.write.mode("overwrite").json(path)


def load_schema(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return spark.read.schema(ddl).json(path)


def save_results(transformed: DataFrame, metadata: DataFrame, validation: DataFrame, report_lines: DataFrame,
                 root: str) -> dict:
    """Transformed table as Parquet, metadata and validation as JSON,
    the report as text."""
    paths = {k: f"{root}/{k}" for k in ("transformed_data.parquet", "feature_metadata.json",
                                       "validation_results.json", "final_report.txt")}
    transformed.write.mode("overwrite").parquet(paths["transformed_data.parquet"])
    metadata.write.mode("overwrite").json(paths["feature_metadata.json"])
    validation.write.mode("overwrite").json(paths["validation_results.json"])
    report_lines.select(F.col("value").cast("string")).write.mode("overwrite").text(paths["final_report.txt"])
    return paths


def save_generated(df: DataFrame, path: str) -> None:
    """Parquet when the path ends with .parquet, else CSV with header."""
    if path.rstrip("/").endswith(".parquet"):
        df.write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").option("header", True).csv(path)


def save_metric_log(log: DataFrame, path: str) -> None:
    """A10: (metric, value, timestamp) as CSV with header."""
    log.select("metric", "value", "timestamp").write.mode("overwrite").option("header", True).csv(path)


def load_summary(df: DataFrame, name: str) -> DataFrame:
    """Rows and columns (process memory is not meaningful for a
    distributed table and is omitted)."""
    return df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows",
                                                         F.lit(len(df.columns)).alias("columns"))
