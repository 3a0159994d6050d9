"""Nearest-neighbour mutual information between a class and a number (C11).

For a row of class c with value v, r is the distance to its k-th nearest
value within c (k at most the other rows of c) and m counts the rows of any
class nearer than r, itself included (rows of equal value where r is 0):

    MI = psi(n) + mean(psi(k_c)) - mean(psi(n_c)) - mean(psi(m)),   at least 0

in nats, psi the digamma function, over the rows of classes with two rows or
more.  Rows where either side is NULL (or NaN) are left out.

Everything runs on distinct (class, value) counts, so a hot value is one row.
Neighbours come from exact positions cut into chunks with k halo rows at each
side; a class is never one task's window.  Rows within a radius are counted by
joining the radius's ends to a prefix sum over values and ends together, so no
two rows are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.operators.ranks import cumulative
from tabvet.session import cut_lineage, sized

NEIGHBOURS = 3
#: Distinct values a chunk of a class has.
CHUNK = 8192


def digamma(n: Column) -> Column:
    """psi of positive integers: eight steps of the recurrence, then the
    asymptotic series (error below 1e-12)."""
    x = n.cast("double") + 8.0
    inv2 = 1.0 / (x * x)
    tail = F.log(x) - 0.5 / x - inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return tail - sum((1.0 / (n + F.lit(float(i))) for i in range(8)), F.lit(0.0))


def digamma_sql(n: str) -> str:
    """The same formula for DuckDB."""
    x = f"({n} + 8.0)"
    steps = " - ".join(f"1.0 / ({n} + {i}.0)" for i in range(8))
    i2 = f"(1.0 / ({x} * {x}))"
    return (f"(ln({x}) - 0.5 / {x} - {i2} * (1.0 / 12 - {i2} * (1.0 / 120 - {i2} * (1.0 / 252 - {i2} * "
            f"(1.0 / 240 - {i2} / 132.0)))) - {steps})")


def class_value_counts(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, a, v, cnt) of all (class column, number column) pairs in one job."""
    parts = [F.struct(F.lit(i).alias("pair"), F.col(f"`{a}`").cast("string").alias("a"),
                      F.col(f"`{b}`").cast("double").alias("v")) for i, (a, b) in enumerate(pairs)]
    long = df.select(F.inline(F.array(*parts))).filter("a IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)")
    return long.groupBy("pair", "a", "v").agg(F.count(F.lit(1)).alias("cnt"))


def _with_radius(df: DataFrame, k: int) -> DataFrame:
    """Adds ``r``, the distance at which the rows around reach ``_k``; needs
    the window columns of :func:`radii`.  Of n rows still wanted, some are the
    nearest at the left and the rest at the right: the split that reaches least
    far.  Steps are columns of their own, which keeps the compiled code small."""
    for j in range(2, k + 1):                   # rows among the j nearest values at a side
        df = df.withColumns({f"_{s}c{j}": F.col(f"_{s}c{j}") + F.col(f"_{s}c{j - 1}") for s in "lr"})
    # distance of the n-th nearest row at a side, NULL where there is none
    df = df.withColumns({f"_{s}d{n}": F.abs(F.col("v") - F.coalesce(*[
        F.when(F.col(f"_{s}c{j}") >= n, F.col(f"_{s}v{j}")) for j in range(1, k + 1)]))
        for s in "lr" for n in range(1, k + 1)})
    df = df.withColumns({f"_w{n}": F.least(*[F.col(f"_ld{n}") if i == n else F.col(f"_rd{n}") if i == 0 else
                                             F.when(F.col(f"_ld{i}") > F.col(f"_rd{n - i}"), F.col(f"_ld{i}"))
                                             .when(F.col(f"_ld{i}").isNotNull(), F.col(f"_rd{n - i}"))
                                             for i in range(n + 1)]) for n in range(1, k + 1)})
    wanted, r = F.col("_k") - (F.col("cnt") - 1), F.when(F.col("cnt") > F.col("_k"), F.lit(0.0))
    for n in range(1, k + 1):
        r = r.when(wanted == n, F.col(f"_w{n}"))
    return df.withColumn("r", r)


def radii(counts: DataFrame, k: int) -> DataFrame:
    """(pair, a, v, cnt, n_class, _k, r): distance of each distinct value to
    its k-th nearest row in its class."""
    totals = counts.groupBy("pair", "a").agg(F.sum("cnt").alias("n_class")).filter("n_class > 1")
    kept = cut_lineage(counts.join(sized(totals), ["pair", "a"]))
    placed = cumulative(kept.withColumn("one", F.lit(1)), ["pair", "a"], "v", ["one"], many_groups=True) \
        .select("pair", "a", "v", "cnt", "n_class", (F.col("cum_one") - 1).alias("at"))
    own = F.floor(F.col("at") / CHUNK)
    # k rows at each edge of a chunk are lent to the chunk beside it
    lent = placed.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_distinct(F.array(
        own, F.floor((F.col("at") - k) / CHUNK), F.floor((F.col("at") + k) / CHUNK)))))
    w = Window.partitionBy("pair", "a", "_chunk").orderBy("at")
    for j in range(1, k + 1):
        lent = (lent.withColumn(f"_lv{j}", F.lag("v", j).over(w)).withColumn(f"_lc{j}", F.lag("cnt", j).over(w))
                .withColumn(f"_rv{j}", F.lead("v", j).over(w)).withColumn(f"_rc{j}", F.lead("cnt", j).over(w)))
    near = lent.filter("_chunk = _own").withColumn("_k", F.least(F.lit(k), F.col("n_class") - 1))
    return _with_radius(near, k).select("pair", "a", "v", "cnt", "n_class", "_k", "r")


def neighbour_information(df: DataFrame, pairs: list[tuple[str, str]], k: int = NEIGHBOURS) -> DataFrame:
    """(col1, col2, mi) of each pair (class column, number column); a pair
    without a class of two rows has 0."""
    spark = df.sparkSession
    found = cut_lineage(radii(class_value_counts(df, pairs), k)
                        .withColumn("lo", F.col("v") - F.col("r")).withColumn("hi", F.col("v") + F.col("r")))
    ends = found.select("pair", F.inline(F.array(*[F.struct(F.col(x).alias("x"), c.alias("c")) for x, c in (
        ("v", F.col("cnt")), ("lo", F.lit(0).cast("long")), ("hi", F.lit(0).cast("long")))])))
    line = cumulative(ends.groupBy("pair", "x").agg(F.sum("c").alias("c")), ["pair"], "x", ["c"])
    line = cut_lineage(line.select("pair", "x", "c", F.col("cum_c").alias("upto")))
    below = line.select("pair", F.col("x").alias("lo"), F.col("upto").alias("_upto_lo"), F.col("c").alias("_at"))
    above = line.select("pair", F.col("x").alias("hi"), (F.col("upto") - F.col("c")).alias("_below_hi"))
    counted = found.join(below, ["pair", "lo"]).join(above, ["pair", "hi"])
    m = F.when(F.col("r") > 0, F.greatest(F.col("_below_hi") - F.col("_upto_lo"), F.lit(1))).otherwise(F.col("_at"))
    term = digamma(F.col("_k")) - digamma(F.col("n_class")) - digamma(m)
    per = counted.groupBy("pair").agg(F.sum("cnt").alias("n"), F.sum(F.col("cnt") * term).alias("s"))
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, col1 string, col2 string")
    mi = F.greatest(digamma(F.col("n")) + F.col("s") / F.col("n"), F.lit(0.0))
    return F.broadcast(names).join(per, "pair", "left").select("col1", "col2", F.coalesce(mi, F.lit(0.0)).alias("mi"))
