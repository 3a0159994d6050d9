"""Generalised-Pareto fit of upper tails by maximum likelihood.

The two parameters of the excesses e over a threshold reduce to one: with
tau = shape / scale the best shape is mean(log(1 + tau e)), so the likelihood is
a curve in tau,

    -(log(shape / tau) + shape + 1)   a row, or  -(log(mean) + 1)  at tau = 0

searched on a grid that is refined around its best point PASSES times.  A pass
evaluates GRID points of every column in one aggregation over the distinct
excesses, so the number of jobs depends neither on rows nor on columns.

A point x of the grid stands for tau = -(1 - 10^x) / max for x < 0 (bounded
tails) and tau = (10^x - 1) / geometric mean for x >= 0, which is a few units
for any shape, however far the largest excess lies.  Below a shape of -1 the
likelihood has no maximum, so shapes from -1 on are considered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.operators.profile import quantiles, to_long
from tabvet.session import cut_lineage

#: Threshold quantile and least number of excesses (more than LEAST are needed).
QUANTILE, LEAST = 0.9, 10
LOW, HIGH = -6.0, 12.0
GRID, PASSES = 64, 4
#: Below this size of tau x mean the tail counts as exponential.
FLAT = 1e-9


def _tau(x: Column, middle: Column, top: Column) -> Column:
    return F.when(x < 0, -(1.0 - F.pow(F.lit(10.0), x)) / top).otherwise((F.pow(F.lit(10.0), x) - 1.0) / middle)


def excesses(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(feature, thr) and the distinct excesses (feature, e, cnt)."""
    long = to_long(df, cols).filter(F.col("v").isNotNull())
    thr = cut_lineage(quantiles(long, ["feature"], "v", [QUANTILE]).select("feature", F.col("q").alias("thr")))
    # one row per column
    over = long.join(F.broadcast(thr), "feature").filter(F.col("v") > F.col("thr"))
    return thr, cut_lineage(over.groupBy("feature", (F.col("v") - F.col("thr")).alias("e"))
                            .agg(F.count(F.lit(1)).alias("cnt")))


def fit(counts: DataFrame) -> DataFrame:
    """(feature, n_excess, shape, scale) by maximum likelihood."""
    facts = cut_lineage(counts.groupBy("feature").agg(
        F.sum("cnt").alias("n"), (F.sum(F.col("e") * F.col("cnt")) / F.sum("cnt")).alias("mean"), F.max("e").alias("top"),
        F.exp(F.sum(F.log("e") * F.col("cnt")) / F.sum("cnt")).alias("middle"))
        .withColumn("x", F.lit((LOW + HIGH) / 2)).withColumn("shape", F.lit(0.0)).withColumn("scale", F.col("mean")))
    half = (HIGH - LOW) / 2
    for _ in range(PASSES):
        step = 2 * half / GRID
        # columns x GRID rows
        grid = facts.select("feature", "n", "mean", "middle", "top", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("i"), "x") \
            .withColumn("x", F.col("x") + (F.col("i") - GRID // 2) * step) \
            .withColumn("tau", _tau(F.col("x"), F.col("middle"), F.col("top")))
        taus = grid.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "tau"))),
                                                       lambda g: g["tau"]).alias("taus"))
        sums = (counts.join(F.broadcast(taus), "feature").select("feature", "e", "cnt", F.posexplode("taus").alias("i", "tau"))
                .groupBy("feature", "i").agg(F.sum(F.col("cnt") * F.log1p(F.col("tau") * F.col("e"))).alias("s")))
        flat = F.abs(F.col("tau") * F.col("mean")) < FLAT
        shape = F.when(flat, 0.0).otherwise(F.col("s") / F.col("n"))
        scale = F.when(flat, F.col("mean")).otherwise(F.col("shape") / F.col("tau"))
        scored = (sums.join(F.broadcast(grid), ["feature", "i"]).withColumn("shape", shape).withColumn("scale", scale)
                  .filter("shape >= -1 AND scale > 0")
                  .withColumn("fit", -(F.log("scale") + F.col("shape") + 1.0)))
        best = scored.groupBy("feature").agg(F.max(F.struct("fit", (-F.col("i")).alias("i"), "x", "shape", "scale")).alias("b"))
        facts = cut_lineage(facts.drop("x", "shape", "scale").join(F.broadcast(best.select("feature", "b.x", "b.shape", "b.scale")), "feature"))
        half = step
    return facts.select("feature", F.col("n").alias("n_excess"), "shape", "scale")


def tail_behavior(df: DataFrame, cols: list[str]) -> DataFrame:
    """Shape of the excesses over the 90th percentile, LIGHT (< 0.3),
    MODERATE (< 1) or HEAVY; INSUFFICIENT_DATA up to ten excesses."""
    thr, counts = excesses(df, cols)
    fitted = fit(counts).filter(F.col("n_excess") > LEAST)
    sizes = counts.groupBy("feature").agg(F.sum("cnt").alias("n"))
    j = thr.join(F.broadcast(sizes), "feature", "left").join(F.broadcast(fitted), "feature", "left")
    label = (F.when(F.coalesce("n", F.lit(0)) <= LEAST, "INSUFFICIENT_DATA").otherwise(label_of(F.col("shape"))))
    return j.select("feature", "thr", F.coalesce("n", F.lit(0)).alias("n_excess"), F.col("shape").alias("tail_index"),
                    F.col("scale").alias("tail_scale"), label.alias("tail_behavior"))


def label_of(shape: Column) -> Column:
    return (F.when(shape.isNull(), "UNKNOWN").when(shape < 0.3, "LIGHT_TAILED").when(shape < 1.0, "MODERATE_TAILED")
            .otherwise("HEAVY_TAILED"))


def fit_sql(source: str) -> str:
    """CTEs ending in ``gpd`` (feature, n, shape) for DuckDB; ``source`` has
    the excesses (feature, e) row by row."""
    mid, half, last = (LOW + HIGH) / 2, (HIGH - LOW) / 2, "p0"
    out = f"""gc AS MATERIALIZED (SELECT feature, e, count(*) AS cnt FROM {source} GROUP BY 1, 2),
p0 AS (SELECT feature, sum(cnt) AS n, sum(e * cnt) / sum(cnt) AS mean, exp(sum(ln(e) * cnt) / sum(cnt)) AS middle, max(e) AS top, {mid} AS x FROM gc GROUP BY feature)"""
    for k in range(1, PASSES + 1):
        step = 2 * half / GRID
        out += f""",
g{k} AS (SELECT *, CASE WHEN x < 0 THEN -(1.0 - pow(10.0, x)) / top ELSE (pow(10.0, x) - 1.0) / middle END AS tau
  FROM (SELECT feature, n, mean, middle, top, i, x + (i - {GRID // 2}) * {step!r} AS x FROM {last}, range(0, {GRID + 1}) r(i))),
s{k} AS (SELECT feature, i, sum(cnt * ln(1.0 + tau * e)) AS s FROM gc JOIN g{k} USING (feature) GROUP BY 1, 2),
l{k} AS (SELECT *, CASE WHEN abs(tau * mean) < {FLAT} THEN 0.0 ELSE s / n END AS shape FROM g{k} JOIN s{k} USING (feature, i)),
f{k} AS (SELECT *, CASE WHEN abs(tau * mean) < {FLAT} THEN mean ELSE shape / tau END AS scale FROM l{k}),
p{k} AS (SELECT feature, any_value(n) AS n, any_value(mean) AS mean, any_value(middle) AS middle, any_value(top) AS top, arg_max(x, q) AS x,
  arg_max(shape, q) AS shape FROM (SELECT *, -(ln(scale) + shape + 1.0) AS q FROM f{k} WHERE shape >= -1 AND scale > 0) GROUP BY feature)"""
        half, last = step, f"p{k}"
    return out + f",\ngpd AS (SELECT feature, n, shape FROM {last})"
