"""Ordered per-entity sequences without one task per entity.

``Window.partitionBy(entity).orderBy(t)`` puts every row of an entity in
one task; a hot entity (a third of all rows) then stalls the job.  These
kernels give each row its exact 1-based position ``_r`` inside its entity
(range buckets of the order key, per-(entity, bucket) counts turned into
offsets on a small table), then cut every entity into chunks of at most
``rows_per_chunk`` positions.  A frame of the previous ``halo`` rows is
exact because the last ``halo`` rows of each chunk are copied into the
next one (flagged ``_halo`` and dropped after the window).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.operators.ranks import order_key, with_bucket, with_const_array

ROWS_PER_CHUNK = 1_000_000


def _n_buckets(df: DataFrame, rows_per_chunk: int) -> int:
    n = df.count()
    return int(max(1, -(-n // rows_per_chunk)))


def row_index(df: DataFrame, entity: list[str], order: list[str],
              rows_per_chunk: int = ROWS_PER_CHUNK, n_buckets: int | None = None) -> DataFrame:
    """Add ``_r``: 1-based position of the row within its entity, ordered
    by ``order`` (which must make rows unique within an entity)."""
    nb = n_buckets or _n_buckets(df, rows_per_chunk)
    key = order_key(df, order[0])
    d = df.withColumn("_ok", key)
    if nb > 1:
        probs = [i / nb for i in range(1, nb)]
        bounds = d.agg(F.array_distinct(F.percentile_approx("_ok", probs, 10000)).alias("b")).first()["b"]
        d = with_const_array(d, "_bnd", bounds)
        d = with_bucket(d, "_bnd", "_ok", nb, "_bk").drop("_bnd")
    else:
        d = d.withColumn("_bk", F.lit(0))
    counts = d.groupBy(*entity, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    # one row per (entity, bucket): per-entity windows hold at most nb rows
    w = Window.partitionBy(*entity).orderBy("_bk")
    offs = counts.select(*entity, "_bk", (F.sum("_c").over(w) - F.col("_c")).alias("_off"))
    j = d.join(offs, [*entity, "_bk"])
    wr = Window.partitionBy(*entity, "_bk").orderBy(*order)
    return j.withColumn("_r", F.col("_off") + F.row_number().over(wr)).drop("_off", "_bk", "_ok")


def chunked(df: DataFrame, entity: list[str], order: list[str], halo: int = 0,
            rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """``row_index`` plus ``_chunk`` and ``_halo``: rows whose position is
    among the last ``halo`` of a chunk are also emitted into the next chunk
    with ``_halo = true``.  Windows partitioned by (entity, _chunk) and
    ordered by ``_r`` then see exact frames of up to ``halo`` preceding rows."""
    if halo >= rows_per_chunk:
        raise ValueError("halo must be smaller than rows_per_chunk")
    d = row_index(df, entity, order, rows_per_chunk)
    c = ((F.col("_r") - 1) / F.lit(rows_per_chunk)).cast("long")
    tail = ((F.col("_r") - 1) % rows_per_chunk) >= (rows_per_chunk - halo) if halo > 0 else F.lit(False)
    d = d.withColumn("_c0", c)
    d = d.withColumn("_chunk", F.explode(F.when(tail, F.array(F.col("_c0"), F.col("_c0") + 1))
                                         .otherwise(F.array(F.col("_c0")))))
    return d.withColumn("_halo", F.col("_chunk") != F.col("_c0")).drop("_c0")


def frame_window(entity: list[str], lower: int) -> Window:
    """rowsBetween(lower, 0) over a ``chunked`` frame (lower <= 0)."""
    return Window.partitionBy(*entity, "_chunk").orderBy("_r").rowsBetween(lower, 0)


def with_rolling(df: DataFrame, entity: list[str], order: list[str], size: int,
                 columns: dict[str, callable], rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Add columns computed over the frame of the current and the previous
    ``size - 1`` rows of the same entity.  ``columns``: name -> function
    (Window) -> Column.  Output keeps the original rows plus ``_r``."""
    d = chunked(df, entity, order, halo=max(size - 1, 0), rows_per_chunk=rows_per_chunk)
    w = frame_window(entity, -(size - 1))
    d = d.select("*", *[fn(w).alias(name) for name, fn in columns.items()])
    return d.filter(~F.col("_halo")).drop("_chunk", "_halo")


def with_lag(df: DataFrame, entity: list[str], order: list[str], value: str, out: str,
             offset: int = 1, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Previous value (``offset`` rows back) within the entity."""
    d = chunked(df, entity, order, halo=offset, rows_per_chunk=rows_per_chunk)
    w = Window.partitionBy(*entity, "_chunk").orderBy("_r")
    d = d.withColumn(out, F.lag(value, offset).over(w))
    return d.filter(~F.col("_halo")).drop("_chunk", "_halo")


def with_prefix(df: DataFrame, entity: list[str], order: list[str], value: str, out: str,
                how: str = "min", inclusive: bool = False, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Running min / max / sum of ``value`` over all earlier rows of the
    entity (``inclusive`` adds the current row): within-chunk prefix plus
    a carry from earlier chunks computed on a (entity, chunk) summary."""
    agg = {"min": F.min, "max": F.max, "sum": F.sum}[how]
    d = chunked(df, entity, order, halo=0, rows_per_chunk=rows_per_chunk).drop("_halo")
    upper = 0 if inclusive else -1
    w = Window.partitionBy(*entity, "_chunk").orderBy("_r").rowsBetween(Window.unboundedPreceding, upper)
    d = d.withColumn("_in", agg(value).over(w))
    summ = d.groupBy(*entity, "_chunk").agg(agg(value).alias("_cv"))
    wc = Window.partitionBy(*entity).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = summ.select(*entity, "_chunk", agg("_cv").over(wc).alias("_carry"))
    j = d.join(carry, [*entity, "_chunk"])
    if how == "sum":
        combined = F.coalesce(F.col("_in"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    else:
        fn = F.least if how == "min" else F.greatest
        combined = fn(F.col("_in"), F.col("_carry"))  # least/greatest skip NULLs
    return j.withColumn(out, combined).drop("_in", "_carry", "_chunk")


def last_n(df: DataFrame, entity: list[str], order: list[str], n: int,
           rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Rows among the newest ``n`` of their entity (by ``order``):
    position from the end = entity size - _r + 1, entity sizes from a
    small grouped count."""
    d = row_index(df, entity, order, rows_per_chunk)
    sizes = d.groupBy(*entity).agg(F.count(F.lit(1)).alias("_n"))
    j = d.join(sizes, entity)
    return j.withColumn("_from_end", F.col("_n") - F.col("_r") + 1).filter(F.col("_from_end") <= n) \
        .drop("_n")
