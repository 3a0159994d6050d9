"""Pairwise distances of a whole table: exact largest, estimated mean.

The largest distance is found by branch and bound over pairs of cells.  A
cell is the bounding box of its points in a grid that gets finer every round.
A pair of boxes has a nearest and a farthest possible distance; pairs whose
farthest distance does not beat the best nearest distance are dropped, and
only children of pairs that stay are compared in the next round, so points in
the middle leave early and no pair of points is ever listed.  Points that all
lie on one sphere keep as many pairs of cells as they have antipodes.

The mean comes from seeded pairs: in each of ``rounds`` rounds every row falls
into one of n/2 buckets by a hash of its key, and the rows of a bucket are
paired.  Every pair is equally likely, so the mean over pairs is that of the
table within a standard error of about sd / sqrt(rounds * n).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.hashing import hu
from tabvet.session import cut_lineage, sized

#: A cell is cut into 2 ** SPLIT_BITS children, over at most that many columns.
SPLIT_BITS = 4
#: Bounds this close (relative) are the same distance.
CLOSE = 1e-12
#: Cells are at least this power of two narrower than the table.
DEEPEST = 50


def _points(df: DataFrame, cols: list[str], *others: Column) -> DataFrame:
    """(x array<double>, others...) of the rows without NULL or NaN."""
    x = [F.col(f"`{c}`").cast("double") for c in cols]
    whole = reduce(lambda a, b: a & b, [v.isNotNull() & ~F.isnan(v) for v in x])
    return df.filter(whole).select(F.array(*x).alias("x"), *others)


def _cell(x: Column, lo: list[float], width: list[float], level: list[int]) -> Column:
    """Grid place of a point; halving a cell's side shifts the place by a bit."""
    place = [F.least(F.floor((F.get(x, j) - lo[j]) / width[j] * float(1 << n)), F.lit((1 << n) - 1)) if width[j] > 0 else F.lit(0)
             for j, n in enumerate(level)]
    return F.array(*[p.cast("long") for p in place])


def _norm(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts), F.lit(0.0)))


def diameter(df: DataFrame, cols: list[str]) -> float:
    """Largest Euclidean distance between two rows (to 1e-12 of itself); 0
    for fewer than two different rows.  Rows with a NULL or NaN are left out."""
    points = _points(df, cols)
    d = len(cols)
    ends = points.agg(*[f(F.get("x", j)).alias(f"{n}{j}") for j in range(d) for n, f in (("lo", F.min), ("hi", F.max))]).head()
    if ends["lo0"] is None:
        return 0.0
    lo = [ends[f"lo{j}"] for j in range(d)]
    width = [ends[f"hi{j}"] - lo[j] for j in range(d)]
    turn = sorted((j for j in range(d) if width[j] > 0), key=lambda j: -width[j])
    if not turn:
        return 0.0
    level, best = [0] * d, 0.0
    root = F.array(*[F.lit(0).cast("long")] * d)
    pairs = df.sparkSession.range(1).select(root.alias("a"), root.alias("b"))
    while True:
        cut = turn[:SPLIT_BITS]
        turn = turn[len(cut):] + cut
        before, level = level, [n + SPLIT_BITS // len(cut) * (j in cut) for j, n in enumerate(level)]
        if any(before):
            stay = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
            points = cut_lineage(points.join(sized(stay), _cell(F.col("x"), lo, width, before) == F.col("cell"), "left_semi"))
        cells = cut_lineage(points.groupBy(_cell(F.col("x"), lo, width, level).alias("cell")).agg(
            F.array(*[F.min(F.get("x", j)) for j in range(d)]).alias("lo"),
            F.array(*[F.max(F.get("x", j)) for j in range(d)]).alias("hi")))
        parent = F.array(*[F.shiftright(F.get("cell", j), level[j] - before[j]) for j in range(d)])
        side = {s: cells.select(parent.alias(s), F.col("cell").alias(f"{s}_cell"), F.col("lo").alias(f"{s}_lo"),
                                F.col("hi").alias(f"{s}_hi")) for s in "ab"}
        far, near = [], []
        for j in range(d):
            up = F.get("a_hi", j) - F.get("b_lo", j)
            down = F.get("b_hi", j) - F.get("a_lo", j)
            far.append(F.greatest(up, down))
            near.append(F.greatest(F.get("a_lo", j) - F.get("b_hi", j), F.get("b_lo", j) - F.get("a_hi", j), F.lit(0.0)))
        pairs = cut_lineage(
            pairs.join(side["a"], "a").join(side["b"], "b").filter((F.col("a") != F.col("b")) | (F.col("a_cell") <= F.col("b_cell")))
            .select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), _norm(far).alias("far"), _norm(near).alias("near"))
            .filter(F.col("far") > best * (1 + CLOSE)))
        top = pairs.agg(F.max("near").alias("near"), F.max("far").alias("far")).head()
        if top["far"] is None:
            return best
        best = max(best, top["near"])
        if top["far"] <= best * (1 + CLOSE) or max(level) > DEEPEST:
            return best
        pairs = pairs.filter(F.col("far") > best * (1 + CLOSE)).select("a", "b")


def mean_distance(df: DataFrame, cols: list[str], key: list[str], rounds: int = 4, seed: int = 42) -> DataFrame:
    """One row: mean_distance, mean_error (standard error of the estimate) and
    pairs (number of pairs measured, about ``rounds`` per row).  ``key`` names
    a row: rows of one key would always meet, so it has to be unique.  Fewer
    than two rows: 0 pairs and NULLs; one pair: the error is NULL."""
    x = _points(df, cols, *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(key)])
    n = x.agg(F.greatest(F.floor(F.count(F.lit(1)) / 2), F.lit(1)).alias("half"))
    dealt = (x.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
             .join(F.broadcast(n))                                     # one row
             .select("round", "x", F.floor(hu(seed, "round", *[f"k{i}" for i in range(len(key))]) * F.col("half")).alias("bucket")))
    met = dealt.groupBy("round", "bucket").agg(F.collect_list("x").alias("met")).filter(F.size("met") > 1)

    def apart(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))

    each = F.flatten(F.transform("met", lambda a, i: F.transform(
        F.slice("met", i + 2, F.size("met")), lambda b: apart(a, b))))
    return met.select(F.explode(each).alias("dist")).agg(
        F.avg("dist").alias("mean_distance"), (F.stddev_samp("dist") / F.sqrt(F.count("dist"))).alias("mean_error"),
        F.count("dist").alias("pairs"))


def diversity(df: DataFrame, cols: list[str], key: list[str], rounds: int = 4, seed: int = 42) -> DataFrame:
    """I24, one row: mean_distance, mean_error, pairs, max_distance and
    diversity_score = mean over largest distance; 1 without spread."""
    longest = F.lit(diameter(df, cols))
    return mean_distance(df, cols, key, rounds, seed).select(
        "*", longest.alias("max_distance"),
        F.when(longest > 0, F.col("mean_distance") / longest).otherwise(F.lit(1.0)).alias("diversity_score"))
