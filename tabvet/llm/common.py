"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.session import checkpoint_dir, table

#: Characters that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def body(docs: DataFrame) -> Column:
    """The text with NULL as the empty string."""
    return F.coalesce(docs["text"], F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without its blanks."""
    return F.translate(text, BLANKS, "")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, so
    that later jobs neither recompute it nor depend on one executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: sizes partitions and buckets."""
    row = docs.agg(F.sum(F.octet_length(docs["text"]).cast("long")).alias("n")).head()
    return int(row["n"] or 0)
