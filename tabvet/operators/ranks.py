"""Global ordered statistics without a single-partition window (PS kernel).

``Window.orderBy(v)`` without ``partitionBy`` moves every row into one
task.  Instead, values are first pre-aggregated to (group, value, count),
cut into range buckets at approximate quantiles (a small per-group array
found by ``percentile_approx``), bucket totals are turned into offsets on
a tiny table, and the running sum is computed inside each (group, bucket)
window.  A hot value is one pre-aggregated row, so skew cannot pile rows
into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.session import sized

DEFAULT_BUCKETS = 256


def _bucket_expr(bounds: str, v: str) -> F.Column:
    """Number of ``bounds`` elements strictly below ``v`` (binary search
    over the sorted array, O(log B) per value)."""
    return F.expr(
        f"aggregate(sequence(1, 13), named_struct('lo', 0, 'hi', size({bounds})), "
        f"(acc, i) -> IF(acc.lo < acc.hi, "
        f"  IF(try_element_at({bounds}, CAST((acc.lo + acc.hi) div 2 AS INT) + 1) < {v}, "
        f"     named_struct('lo', CAST((acc.lo + acc.hi) div 2 AS INT) + 1, 'hi', acc.hi), "
        f"     named_struct('lo', acc.lo, 'hi', CAST((acc.lo + acc.hi) div 2 AS INT))), acc), "
        f"acc -> acc.lo)")


def with_bucket(df: DataFrame, bounds: str, v: str, n_buckets: int, name: str = "_bucket") -> DataFrame:
    """Adds ``name``: number of ``bounds`` elements strictly below ``v``, by
    binary search over the sorted array of fewer than ``n_buckets``.  A step is
    a column of its own, so the steps are compiled and none is run twice."""
    df = df.withColumn(name, F.lit(0))
    step = 1 << max(n_buckets - 1, 1).bit_length() - 1
    while step:
        below = F.coalesce(F.get(bounds, F.col(name) + (step - 1)) < F.col(v), F.lit(False))
        df = df.withColumn(name, F.col(name) + F.when(below, F.lit(step)).otherwise(F.lit(0)))
        step //= 2
    return df


def order_key(df: DataFrame, value_col: str) -> F.Column:
    """A double that is monotone (non-decreasing) in the value's sort
    order: numbers as themselves; text as its first 6 UTF-8 bytes read as a
    48-bit integer (Spark compares strings bytewise), so range buckets cut
    on this key never split equal values and keep global order."""
    dt = df.schema[value_col].dataType
    c = F.col(f"`{value_col}`")
    if isinstance(dt, (T.StringType, T.BinaryType)):
        b = F.encode(c, "UTF-8") if isinstance(dt, T.StringType) else c
        hx = F.rpad(F.hex(F.substring(b, 1, 6)), 12, "0")
        return F.conv(hx, 16, 10).cast("double")
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


#: Distinct texts per group that text bounds are taken from.
TEXT_SAMPLE = 16_384


def _text_bounds(values: DataFrame, group_cols: list[str], value_col: str, n_buckets: int,
                 small=F.broadcast) -> DataFrame:
    """(group..., _bounds): texts that cut each group's distinct values into
    ``n_buckets`` ranges of like size, from about TEXT_SAMPLE of them picked
    by hash.  Whole texts are compared, so a common beginning does no harm."""
    values = values.select(*group_cols, value_col)
    sizes = values.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("_group_size"))
    place = F.pmod(F.xxhash64(value_col), F.lit(1 << 40)) / float(1 << 40)
    picked = (values.join(small(sizes), group_cols).filter(place * F.col("_group_size") < TEXT_SAMPLE)
              .groupBy(*group_cols).agg(F.array_sort(F.collect_list(value_col)).alias("_s")))
    cut = F.transform(F.sequence(F.lit(1), F.lit(n_buckets - 1)),
                      lambda i: F.get("_s", F.floor(i * F.size("_s") / n_buckets).cast("int")))
    cuts = picked.select(*group_cols, F.array_distinct(F.filter(cut, lambda x: x.isNotNull())).alias("_bounds"))
    # a group too small to have been picked from is one bucket
    return sizes.join(cuts, group_cols, "left").select(
        *group_cols, F.coalesce("_bounds", F.array().cast("array<string>")).alias("_bounds"))


def value_counts(df: DataFrame, group_cols: list[str], value_col: str) -> DataFrame:
    """(group..., value, cnt) with NULL values dropped (map-side combined)."""
    return (df.filter(F.col(value_col).isNotNull())
            .groupBy(*group_cols, value_col).agg(F.count(F.lit(1)).alias("cnt")))


def cumulative(counts: DataFrame, group_cols: list[str], value_col: str,
               count_cols: list[str] | str = "cnt",
               n_buckets: int = DEFAULT_BUCKETS, with_next: bool = False, many_groups: bool = False) -> DataFrame:
    """Add ``cum_<c>`` = inclusive running sum of each count column in
    ascending ``value_col`` order within each group, plus ``tot_<c>``
    (group total).  ``many_groups``: the groups are data values, not columns,
    so their bounds and offsets are broadcast only if they measure small."""
    small = sized if many_groups else F.broadcast
    if isinstance(count_cols, str):
        count_cols = [count_cols]
    g = list(group_cols)
    if not g:
        counts, g = counts.withColumn("_all", F.lit(0)), ["_all"]
    if isinstance(counts.schema[value_col].dataType, T.StringType):
        keyed = counts.withColumn("_okey", F.col(f"`{value_col}`"))
        bounds = _text_bounds(keyed, g, "_okey", n_buckets, small)
    else:
        probs = [i / n_buckets for i in range(1, n_buckets)]
        keyed = counts.withColumn("_okey", order_key(counts, value_col))
        bounds = (keyed.groupBy(*g)
                  .agg(F.array_distinct(F.percentile_approx("_okey", probs, 10000)).alias("_bounds")))
    b = keyed.join(small(bounds), g)
    b = with_bucket(b, "_bounds", "_okey", n_buckets).drop("_bounds", "_okey")
    totals = b.groupBy(*g, "_bucket").agg(*[F.sum(c).alias(f"_bt_{c}") for c in count_cols])
    wo = Window.partitionBy(*g).orderBy("_bucket")
    wg = Window.partitionBy(*g)
    # totals has groups x buckets rows: the window over it is tiny
    offsets = totals.select(
        *g, "_bucket",
        *[(F.sum(f"_bt_{c}").over(wo) - F.col(f"_bt_{c}")).alias(f"_off_{c}") for c in count_cols],
        *[F.sum(f"_bt_{c}").over(wg).alias(f"tot_{c}") for c in count_cols])
    j = b.join(small(offsets), g + ["_bucket"])
    wv = Window.partitionBy(*g, "_bucket").orderBy(value_col).rowsBetween(Window.unboundedPreceding, 0)
    extra = []
    if with_next:
        # successor inside the bucket; the last value of a bucket takes the
        # first value of the next non-empty bucket (tiny per-bucket table)
        wl = Window.partitionBy(*g, "_bucket").orderBy(value_col)
        firsts = b.groupBy(*g, "_bucket").agg(F.min(value_col).alias("_first"))
        nxt = firsts.select(*g, "_bucket", F.lead("_first").over(Window.partitionBy(*g).orderBy("_bucket"))
                            .alias("_next_bucket_first"))
        j = j.join(small(nxt), g + ["_bucket"])
        extra = [F.coalesce(F.lead(value_col).over(wl), F.col("_next_bucket_first")).alias("next_v")]
    return j.select(
        *[c for c in counts.columns if c != "_all"],
        *[(F.sum(c).over(wv) + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in count_cols],
        *[F.col(f"tot_{c}") for c in count_cols], *extra)


def average_ranks(df: DataFrame, group_cols: list[str], value_col: str,
                  n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(group..., value, cnt, rank) where rank is the 1-based average rank
    of the value among all non-null values of its group (ties averaged)."""
    vc = value_counts(df, group_cols, value_col)
    c = cumulative(vc, group_cols, value_col, "cnt", n_buckets)
    return c.select(*group_cols, value_col, "cnt",
                    (F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0).alias("rank"),
                    F.col("tot_cnt").alias("n"))


def sorted_gaps(df: DataFrame, group_cols: list[str], value_col: str,
                n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(group..., x, next_x, gap) for consecutive *distinct* values in
    ascending order, without a per-group window over all values: values
    are range-bucketed, ``lead`` runs inside each bucket and the gap across
    a bucket boundary comes from a tiny per-bucket (min, max) table."""
    g = list(group_cols)
    if not g:
        df, g = df.withColumn("_all", F.lit(0)), ["_all"]
    d = df.select(*g, F.col(value_col).cast("double").alias("x")).filter(F.col("x").isNotNull()).distinct()
    probs = [i / n_buckets for i in range(1, n_buckets)]
    bounds = d.groupBy(*g).agg(F.array_distinct(F.percentile_approx("x", probs, 10000)).alias("_bounds"))
    b = d.join(F.broadcast(bounds), g)
    b = with_bucket(b, "_bounds", "x", n_buckets).drop("_bounds")
    w = Window.partitionBy(*g, "_bucket").orderBy("x")
    inner = b.select(*g, "x", F.lead("x").over(w).alias("next_x")).filter(F.col("next_x").isNotNull())
    mm = b.groupBy(*g, "_bucket").agg(F.min("x").alias("bmin"), F.max("x").alias("bmax"))
    wb = Window.partitionBy(*g).orderBy("_bucket")
    cross = mm.select(*g, F.col("bmax").alias("x"), F.lead("bmin").over(wb).alias("next_x")) \
        .filter(F.col("next_x").isNotNull())
    both = inner.unionByName(cross).withColumn("gap", F.col("next_x") - F.col("x"))
    return both.drop("_all") if "_all" in both.columns else both


def with_const_array(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Attach a fitted (bounded) array as column ``name`` through a one-row
    broadcast equi-join, so per-row expressions reference it instead of
    rebuilding a large literal array for every evaluation."""
    spark = df.sparkSession
    one = spark.createDataFrame([(0, [float(v) for v in values])], f"_ck int, {name} array<double>")
    return df.withColumn("_ck", F.lit(0)).join(F.broadcast(one), "_ck").drop("_ck")
