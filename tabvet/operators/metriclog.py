"""Metric-log analytics.

A metric log is a table (metric, value, ts).  A handful of metrics means
a handful of very large groups, so every ordered statistic uses the
chunked sequence kernel (positions inside a metric, frames with halo
rows) instead of ``Window.partitionBy(metric)``; statistics that need
only the newest n readings first reduce to those rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.session import cut_lineage
from tabvet.operators import sequence as S
from tabvet.operators.profile import quantiles

ORDER = ["ts", "event_id"]


def statistics(log: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """L1: count, mean, std (pop), min, max, median, last per metric."""
    base = log.groupBy("metric").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.max_by("value", F.struct(*order)).alias("last"))
    med = quantiles(log, ["metric"], "value", [0.5]).select("metric", F.col("q").alias("median"))
    return base.join(med, "metric")


def last_n(log: DataFrame, n: int, order: list[str] = ORDER, rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """L2: the newest n readings of each metric (position from the end)."""
    return S.last_n(log, ["metric"], order, n, rows_per_chunk).drop("_r")


def mean_last_n(log: DataFrame, n: int = 100, order: list[str] = ORDER,
                rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """L3: mean of the newest n readings per metric."""
    return last_n(log, n, order, rows_per_chunk).groupBy("metric").agg(F.avg("value").alias("mean_last_n"))


def trend(log: DataFrame, window: int = 50, order: list[str] = ORDER,
          rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """L4: least-squares slope of the newest ``window`` readings against
    their position; 0 when a metric has fewer readings."""
    t = S.last_n(log, ["metric"], order, window, rows_per_chunk)
    agg = t.groupBy("metric").agg(F.regr_slope("value", F.col("_r").cast("double")).alias("slope"),
                                  F.count(F.lit(1)).alias("n"))
    return agg.select("metric", F.when(F.col("n") >= window, F.coalesce("slope", F.lit(0.0))).otherwise(0.0)
                      .alias("trend"))


def divergence_flags(log: DataFrame, window: int = 10, factor: float = 1.4, order: list[str] = ORDER,
                     rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """L5 (re-aimed from an LR-scheduler check): at each reading, mean of
    the newest ``window`` readings versus the ``window`` before them;
    diverging when newest > factor x previous (needs 2 x window readings)."""
    w2 = 2 * window
    d = S.chunked(log, ["metric"], order, halo=w2 - 1, rows_per_chunk=rows_per_chunk)
    base = Window.partitionBy("metric", "_chunk").orderBy("_r")
    d = d.select("*", F.avg("value").over(base.rowsBetween(-(window - 1), 0)).alias("mean_new"),
                 F.avg("value").over(base.rowsBetween(-(w2 - 1), -window)).alias("mean_prev"),
                 F.count(F.lit(1)).over(base.rowsBetween(-(w2 - 1), 0)).alias("_cnt"))
    d = d.filter(~F.col("_halo"))
    full = F.col("_cnt") >= w2
    return d.select(*[c for c in log.columns], "mean_new", "mean_prev",
                    (full & (F.col("mean_new") > factor * F.col("mean_prev"))).alias("diverging"))


def stagnation_flags(log: DataFrame, window: int = 20, tol: float = 1e-3, order: list[str] = ORDER,
                     rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """L6 (re-aimed): population variance of the newest ``window``
    readings below ``tol`` (needs ``window`` readings)."""
    d = S.with_rolling(log, ["metric"], order, window,
                       {"rolling_var": lambda w: F.var_pop("value").over(w),
                        "_cnt": lambda w: F.count(F.lit(1)).over(w)}, rows_per_chunk)
    return d.select(*log.columns, "rolling_var",
                    ((F.col("_cnt") >= window) & (F.col("rolling_var") < tol)).alias("stagnating"))


def best_so_far(log: DataFrame, order: list[str] = ORDER, mode: str = "min",
                rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """A reading strictly better than every earlier reading of its
    metric (the first reading is the best so far)."""
    how = "min" if mode == "min" else "max"
    d = S.with_prefix(log, ["metric"], order, "value", "_prev_best", how, inclusive=False,
                      rows_per_chunk=rows_per_chunk)
    better = (F.col("value") < F.col("_prev_best")) if mode == "min" else (F.col("value") > F.col("_prev_best"))
    return d.withColumn("is_best", F.col("_prev_best").isNull() | better).drop("_prev_best", "_r")


def improvements(log: DataFrame, min_delta: float = 1e-4, mode: str = "min", order: list[str] = ORDER,
                 rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """Readings (``_r`` positions and signed values ``_v`` added) that improve
    on the best of a metric, the best moving only when a reading beats it by
    more than ``min_delta``.  Only a record low can do so; each record points
    to the first later one below it minus the delta (the highest such value,
    as records fall), and the records that the first reading reaches are found
    by doubling the pointers."""
    signed = F.col("value") if mode == "min" else -F.col("value")
    d = S.with_prefix(log.withColumn("_v", signed), ["metric"], order, "_v", "_low", "min", inclusive=False,
                      rows_per_chunk=rows_per_chunk)
    records = cut_lineage(d.filter(F.col("_low").isNull() | (F.col("_v") < F.col("_low")))
                          .select("metric", F.col("_r").alias("r"), F.col("_v").alias("v")))
    both = records.select("metric", "r", F.col("v").alias("at"), F.lit(1).alias("kind"), F.col("v").alias("own")) \
        .unionByName(records.select("metric", "r", (F.col("v") - min_delta).alias("at"), F.lit(0).alias("kind"),
                                    F.lit(None).cast("double").alias("own")))
    below = S.with_prefix(both, ["metric"], ["at", "kind", "r"], "own", "to", "max", inclusive=False,
                          rows_per_chunk=rows_per_chunk).filter("kind = 0")
    jump = cut_lineage(below.select("metric", "r", "to").join(records, ["metric", "r"]).select("metric", "v", "to")
                       .filter(F.col("to").isNotNull()))
    reached = records.filter("r = 1").select("metric", "v")
    while True:
        further = reached.join(jump, ["metric", "v"]).select("metric", F.col("to").alias("v"))
        if further.isEmpty():
            break
        reached = cut_lineage(reached.unionByName(further).distinct())
        ahead = jump.select("metric", F.col("v").alias("to"), F.col("to").alias("next"))
        jump = cut_lineage(jump.join(ahead, ["metric", "to"]).select("metric", "v", F.col("next").alias("to")))
    return reached.join(records, ["metric", "v"]).select("metric", F.col("r").alias("_r"), F.col("v").alias("_v"))


def early_stop_point(log: DataFrame, patience: int = 10, min_delta: float = 1e-4, order: list[str] = ORDER,
                     mode: str = "min", rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """Per metric the first position that is ``patience`` readings past
    the last improvement (``improvements``; mode ``max`` for growing metrics);
    metrics that never stop have no row."""
    better = improvements(log, min_delta, mode, order, rows_per_chunk).select("metric", "_r", F.lit(1).alias("_hit"))
    d = S.row_index(log, ["metric"], order, rows_per_chunk).join(better, ["metric", "_r"], "left")
    d = d.withColumn("_imp_r", F.when(F.col("_hit").isNotNull(), F.col("_r")).otherwise(F.lit(0))).drop("_hit")
    d = S.with_prefix(d.drop("_r"), ["metric"], order, "_imp_r", "_last_imp", "max", inclusive=True,
                      rows_per_chunk=rows_per_chunk)
    hits = d.filter(F.col("_r") - F.col("_last_imp") >= patience)
    return hits.groupBy("metric").agg(F.min("_r").alias("stop_position"),
                                      F.min_by(F.struct(*order), "_r").alias("stop_at"))


def ratio_alarm(log: DataFrame, a: str, b: str, bucket: str = "1 hour") -> DataFrame:
    """Per time bucket, mean of metric a over mean of metric b:
    a > 3b -> 'a_weak', b > 3a -> 'b_weak'; balance ratio a/(b + 1e-8)
    above 2 -> 'raise_lr_a', below 0.5 -> 'raise_lr_b'."""
    w = log.filter(F.col("metric").isin(a, b)).groupBy(F.window("ts", bucket).alias("win")).pivot("metric", [a, b]) \
        .agg(F.avg("value"))
    ratio = F.col(a) / (F.col(b) + 1e-8)
    return w.select(F.col("win.start").alias("bucket_start"), F.col(a).alias("mean_a"), F.col(b).alias("mean_b"),
                    F.when(F.col(a) > F.col(b) * 3, "a_weak").when(F.col(b) > F.col(a) * 3, "b_weak")
                    .otherwise("balanced").alias("stability"),
                    F.when(ratio > 2.0, "raise_lr_a").when(ratio < 0.5, "raise_lr_b").otherwise("none").alias("balance"))


def export(wide: DataFrame, ts_col: str, metrics: list[str]) -> DataFrame:
    """Wide metric columns -> (metric, value, timestamp)."""
    return wide.select(F.col(ts_col).alias("timestamp"), *[F.col(m).cast("double").alias(m) for m in metrics]) \
        .unpivot(["timestamp"], metrics, "metric", "value").select("metric", "value", "timestamp")


def retention(log: DataFrame, max_readings: int = 10_000, keep: int = 5_000, order: list[str] = ORDER,
              rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """What a log keeps that is cut back to its newest ``keep`` readings
    whenever it passes ``max_readings``: it then grows again, so a metric of
    n > max_readings readings holds the newest
    keep + (n - max_readings - 1) mod (max_readings + 1 - keep)."""
    d = S.row_index(log, ["metric"], order, rows_per_chunk)
    sizes = d.groupBy("metric").agg(F.count(F.lit(1)).alias("_n"))
    held = F.when(F.col("_n") <= max_readings, F.col("_n")).otherwise(
        keep + (F.col("_n") - max_readings - 1) % (max_readings + 1 - keep))
    return d.join(sizes, "metric").filter(F.col("_n") - F.col("_r") < held).drop("_n", "_r")


def detection_stats(log: DataFrame, window: int = 50, order: list[str] = ORDER,
                    rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """Per metric mean, std (pop), trend and current value."""
    st = statistics(log, order).select("metric", "mean", "std", F.col("last").alias("current"))
    return st.join(trend(log, window, order, rows_per_chunk), "metric")
