"""Small documents tables with every awkward case, and text helpers."""

import re

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
#: Columns that clash with names the operators use inside.
CLASHING = ["key", "page", "row_id", "winner", "won", "rest", "bucket", "kind", "block", "tokens", "_text", "_domain",
            "_verdict", "part", "n", "_id", "budget", "copies"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(n, seed=0):
    import random
    r = random.Random(seed)
    parts = ["the", "of", "er", "an", "on", "sh", "le", "ré", "tion", "ing", "漢"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def awkward(spark, clash=True):
    """Nulls in every column, empty and long texts, ties and repeated rows."""
    base = prose(200, 1)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    rows = [
        (1, base, "en", "src0"), (2, base.replace(" ", "\n"), "en", "src0"), (3, base + " ", "de", "src1"),
        (4, near, "en", "src0"), (5, None, "en", "src2"), (6, "", None, None), (7, " \t\n", "fr", "src2"),
        (8, prose(60, 2), None, "src3"), (9, prose(70, 3), "en", None), (None, prose(80, 4), "en", "src9"),
        (None, prose(80, 4), "en", "src9"), (11, prose(40_000, 5), "en", "src14"), (12, "x" * 60_000, "en", "other"),
        (13, "a b c", "es", "src0"), (14, "a b c", "es", "src0"), (15, "one two", "es", "src0"),
        (8, prose(60, 2), None, "src3"), (16, prose(5, 6) + "\n" + prose(5, 6) + "\nlast\n\n \n", "en", "src1"),
        (17, "###*** $$$ %%% &&& <<< " * 30, "en", "src1"), (18, prose(100, 7) + " all rights reserved", "en", "src1"),
    ]
    df = spark.createDataFrame([(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows], DOCS)
    if clash:
        from pyspark.sql import functions as F
        for c in CLASHING:
            df = df.withColumn(c, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
