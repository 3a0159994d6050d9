"""Column profiling.

All columns of a family are handled by one grouped job over a long
(``feature``, ``v``) form (``unpivot``), so the profile of k columns is one
scan and one small shuffle, not k jobs.  Statistics drop NULLs (NaN is
treated as NULL), as the reference drops missing values before profiling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.normal import phi, phi_inv
from tabvet.operators.ranks import DEFAULT_BUCKETS, cumulative, sorted_gaps, value_counts, with_const_array

_FLOATS = (T.FloatType, T.DoubleType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and not isinstance(f.dataType, T.BooleanType)]


def _clean(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    x = F.col(f"`{c}`").cast("double")
    if isinstance(dt, _FLOATS):
        x = F.nanvl(x, F.lit(None).cast("double"))
    return x


def to_long(df: DataFrame, cols: list[str], kind: str = "double", keep: list[str] | None = None) -> DataFrame:
    """LONG: (keep..., feature, v) with one row per (row, column)."""
    keep = keep or []
    if kind == "double":
        prepared = df.select(*keep, *[_clean(df, c).alias(c) for c in cols])
    else:
        prepared = df.select(*keep, *[F.col(f"`{c}`").cast("string").alias(c) for c in cols])
    return prepared.unpivot(keep, cols, "feature", "v") if keep else prepared.unpivot([], cols, "feature", "v")


# B1 B2 B3 B4 B22 -------------------------------------------------------------

def numeric_profile(df: DataFrame, cols: list[str] | None = None, exact_distinct: bool = True) -> DataFrame:
    """Per numeric column: rows, non-null count, missing rate, mean, std
    (ddof 1), population skewness, excess kurtosis, min, max, distinct
    count, all-integer / all-positive flags, count of infinities."""
    cols = cols or numeric_columns(df)
    long = to_long(df, cols)
    v = F.col("v")
    infinite = v.isin(float("inf"), float("-inf"))
    finite = F.when(~infinite, v)
    first = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("non_null"),
        F.avg(v.isNull().cast("double")).alias("missing_rate"),
        F.avg(finite).alias("mean"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.coalesce(F.bool_and(v == F.floor(v)), F.lit(False)).alias("is_integer"),
        F.coalesce(F.bool_and(v > 0), F.lit(False)).alias("is_positive"),
        F.count_if(infinite).alias("n_inf"),
        F.count(finite).alias("_n"), (F.min(finite) == F.max(finite)).alias("_constant"))
    # moments as sums of powers around the mean: the code of Spark's own is too long to be compiled
    d = finite - F.col("_mean")
    around = long.join(F.broadcast(first.select("feature", F.col("mean").alias("_mean"))), "feature") \
        .groupBy("feature").agg(*[F.sum(x).alias(f"_{k}") for k, x in ((2, d * d), (3, d * d * d), (4, d * d * d * d))])
    # distinct values are counted apart, as they would carry all of the above along with every value
    distinct = long.groupBy("feature").agg(
        (F.count_distinct(v) if exact_distinct else F.approx_count_distinct(v)).alias("unique_count"))
    n, m2 = F.col("_n"), F.when(F.col("_constant"), F.lit(0.0)).otherwise(F.col("_2"))
    return first.join(F.broadcast(around), "feature", "left").join(F.broadcast(distinct), "feature", "left").select(
        "feature", "n_rows", "non_null", "missing_rate", "mean",
        F.when(n > 1, F.sqrt(m2 / (n - 1))).alias("std"),
        F.when(m2 > 0, F.sqrt(n) * F.col("_3") / F.sqrt(m2 * m2 * m2)).alias("skewness"),
        F.when(m2 > 0, n * F.col("_4") / (m2 * m2) - 3.0).alias("kurtosis"),
        "min", "max", "unique_count", "is_integer", "is_positive", "n_inf")


def column_health(profile: DataFrame, max_missing: float = 0.5) -> DataFrame:
    """Column errors: more than ``max_missing`` missing, or any ±inf."""
    return profile.select(
        "feature", "missing_rate", "n_inf",
        ((F.col("missing_rate") > max_missing) | (F.col("n_inf") > 0)).alias("has_error"))


# B5 - B9, B11 ----------------------------------------------------------------

def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, cnt) for text columns; NULLs dropped."""
    return value_counts(to_long(df, cols, kind="string"), ["feature"], "v")


def categorical_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per text column: count, distinct count, cardinality ratio, mode
    (ties: smallest value), mode share, entropy in bits with the +1e-12
    guard, Gini impurity, normalised Shannon entropy, entropy in nats."""
    counts = category_counts(df, cols)
    return categorical_stats(counts)


def categorical_stats(counts: DataFrame) -> DataFrame:
    # per-feature totals: one row per feature -> broadcast, no per-feature window
    tot = counts.groupBy("feature").agg(F.sum("cnt").alias("_n"))
    p = counts.join(F.broadcast(tot), "feature").withColumn("p", F.col("cnt") / F.col("_n"))
    pc = F.col("p")
    agg = p.groupBy("feature").agg(
        F.sum("cnt").alias("n"),
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by("v", F.struct(-F.col("cnt"), F.col("v"))).alias("mode"),
        F.max("cnt").alias("mode_count"),
        (-F.sum(pc * F.log2(pc + F.lit(1e-12)))).alias("entropy_bits"),
        (1.0 - F.sum(pc * pc)).alias("gini"),
        (-F.sum(pc * F.log2(pc))).alias("_h2"),
        (-F.sum(pc * F.log(pc))).alias("entropy_nats"))
    k = F.col("unique_count")
    return agg.select(
        "feature", "n", "unique_count",
        (k / F.col("n")).alias("cardinality"),
        "mode", (F.col("mode_count") / F.col("n")).alias("mode_share"),
        "entropy_bits", "gini",
        F.when(k > 1, F.col("_h2") / F.log2(k.cast("double"))).otherwise(F.col("_h2")).alias("norm_entropy"),
        (k / F.col("n")).alias("uniqueness"),
        "entropy_nats")


# Quantiles --------------------------------------------------------------

def _leading_count(arr: Column, pred) -> Column:
    """Number of leading elements of ``arr`` for which the monotone
    predicate holds (true ... true false ... false): binary search in 14
    steps (arrays up to 16384 elements)."""
    def step(acc, _i):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        ok = pred(F.try_element_at(arr, mid + 1))
        return F.when(acc["lo"] < acc["hi"],
                      F.when(ok, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                      .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))).otherwise(acc)
    init = F.struct(F.lit(0).alias("lo"), F.size(arr).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), init, step, lambda acc: acc["lo"])


def quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float],
              n_buckets: int = DEFAULT_BUCKETS, many_groups: bool = False) -> DataFrame:
    """Exact linear-interpolation quantiles (pandas/NumPy default) per
    group (``many_groups``: groups are data values, see ``cumulative``), distributed: each distinct value knows its position range
    [a, b] from the PS kernel; the targets it serves (lo_i = floor((n-1)p_i)
    or hi_i = ceil((n-1)p_i) inside [a, b]) form one contiguous index range
    found by two binary searches over the sorted probabilities, so a value
    emits only its hits, whatever the number of probabilities.

    Output: (group..., p, q).
    """
    probs = sorted(float(p) for p in probs)
    vc = value_counts(df, group_cols, value_col)
    c = cumulative(vc, group_cols, value_col, "cnt", n_buckets, many_groups=many_groups)
    # the probability array is attached once as a column (one-row broadcast)
    c = with_const_array(c, "_parr", probs)
    parr = F.col("_parr")
    nm1 = (F.col("tot_cnt") - 1).cast("double")
    a, b = F.col("cum_cnt") - F.col("cnt"), F.col("cum_cnt") - 1
    c = c.withColumn("_i1", _leading_count(parr, lambda p: F.ceil(nm1 * p) < a)) \
        .withColumn("_i2", _leading_count(parr, lambda p: F.floor(nm1 * p) <= b) - 1)
    hit = c.select(*group_cols, F.col(value_col).cast("double").alias("x"), a.alias("a"), b.alias("b"),
                   nm1.alias("nm1"), "_parr",
                   # sequence(a, b) counts down when a > b: no hits must be an empty array
                   F.explode(F.when(F.col("_i1") <= F.col("_i2"), F.sequence(F.col("_i1"), F.col("_i2")))
                             .otherwise(F.array().cast("array<int>"))).alias("i"))
    parr = F.col("_parr")
    p = F.element_at(parr, F.col("i") + 1)
    pos = F.col("nm1") * p
    ilo, ihi = F.floor(pos), F.ceil(pos)
    e = hit.select(*group_cols, p.alias("p"), (pos - ilo).alias("frac"),
                   F.when((ilo >= F.col("a")) & (ilo <= F.col("b")), F.col("x")).alias("x_lo"),
                   F.when((ihi >= F.col("a")) & (ihi <= F.col("b")), F.col("x")).alias("x_hi"))
    g = e.groupBy(*group_cols, "p").agg(F.max("x_lo").alias("x_lo"), F.max("x_hi").alias("x_hi"),
                                         F.first("frac").alias("frac"))
    return g.select(*group_cols, "p", (F.col("x_lo") + F.col("frac") * (F.col("x_hi") - F.col("x_lo"))).alias("q"))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """B10 numeric branch: mean, std, min, max, q25, q50, q75 per column."""
    long = to_long(df, cols)
    q = quantiles(long, ["feature"], "v", [0.25, 0.5, 0.75])
    qw = q.groupBy("feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
    qw = qw.select("feature", F.col("`0.25`").alias("q25"), F.col("`0.5`").alias("q50"), F.col("`0.75`").alias("q75"))
    m = long.groupBy("feature").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                   F.min("v").alias("min"), F.max("v").alias("max"))
    return m.join(qw, "feature")


# One-sample KS against N(mean, std) -------------------------------------

def ks_normal(df: DataFrame, cols: list[str], n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """D = sup |F_n - Φ((x-μ)/σ)| per column (σ with ddof 1), plus the
    asymptotic Kolmogorov p-value."""
    long = to_long(df, cols)
    stats = long.groupBy("feature").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    vc = value_counts(long, ["feature"], "v")
    c = cumulative(vc, ["feature"], "v", "cnt", n_buckets).join(F.broadcast(stats), "feature")
    cdf = phi((F.col("v") - F.col("mu")) / F.col("sd"))
    n = F.col("tot_cnt")
    d = c.select("feature", n.alias("n"),
                 F.greatest(F.col("cum_cnt") / n - cdf, cdf - (F.col("cum_cnt") - F.col("cnt")) / n).alias("d"))
    out = d.groupBy("feature").agg(F.max("d").alias("ks_statistic"), F.first("n").alias("n"))
    return out.select("feature", "ks_statistic",
                      kolmogorov_p(F.col("ks_statistic") * F.sqrt(F.col("n").cast("double"))).alias("ks_p_value"))


def kolmogorov_p(x: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov survival function Q(x) = 2 Σ (-1)^{k-1} e^{-2k²x²}."""
    ks = F.sequence(F.lit(1), F.lit(terms))
    s = F.aggregate(ks, F.lit(0.0), lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * x * x))
    return F.when(x <= 0.0, F.lit(1.0)).otherwise(F.least(F.greatest(2.0 * s, F.lit(0.0)), F.lit(1.0)))


# Jarque-Bera normality (re-aimed from Shapiro-Wilk) --------------------

def jarque_bera(profile: DataFrame, alpha: float = 0.05) -> DataFrame:
    """JB = n/6 (S² + K²/4) from B2's moments; p = exp(-JB/2) (χ²₂ tail).
    Re-aimed estimator: the reference's Shapiro-Wilk needs SciPy."""
    n, s, k = F.col("non_null"), F.col("skewness"), F.col("kurtosis")
    jb = n / 6.0 * (s * s + k * k / 4.0)
    return profile.select("feature", jb.alias("jb_statistic"), F.exp(-jb / 2.0).alias("jb_p_value"),
                          (F.exp(-jb / 2.0) > alpha).alias("is_gaussian"))


# Shapiro-Wilk normality ---------------------------------------------------

# Polynomials of Royston (1995), lowest power first.
SW_LARGEST = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
SW_SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_SMALL_MEAN = [0.544, -0.39978, 0.025054, -0.0006714]
SW_SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_SD = [-0.4803, -0.082676, 0.0030302]
SW_GAMMA = [-2.273, 0.459]


def _poly(coefs: list[float], x: Column) -> Column:
    """Sum of coefs[i] x^i."""
    acc = F.lit(float(coefs[-1]))
    for c in coefs[-2::-1]:
        acc = acc * x + F.lit(float(c))
    return acc


def shapiro_wilk(df: DataFrame, cols: list[str], alpha: float = 0.05, largest: int = 5000) -> DataFrame:
    """Shapiro-Wilk W and p-value of each column with 3 to ``largest``
    non-null values (the test is stated for no more; W, p and the verdict of
    other columns are NULL, as are those of a column without spread).

    The weight of a rank is a normal order statistic that depends on n alone;
    a value takes the weights of all ranks it fills, found by exact running
    counts of distinct values.  Only columns that qualify are ranked, so that
    step has at most ``largest`` ranks a column.  p by Royston's
    approximation."""
    long = to_long(df, cols)
    size = long.groupBy("feature").agg(F.count("v").alias("n"), F.avg("v").alias("mean"),
                                       (F.var_samp("v") * (F.count("v") - 1)).alias("ss"))
    asked = size.filter(F.col("n").between(3, largest) & (F.col("ss") > 0))           # a row per column
    vc = value_counts(long.join(F.broadcast(asked.select("feature")), "feature", "left_semi"), ["feature"], "v")
    placed = (cumulative(vc, ["feature"], "v").join(F.broadcast(asked), "feature")
              .withColumn("i", F.explode(F.sequence(F.col("cum_cnt") - F.col("cnt") + 1, F.col("cum_cnt")))))
    n, i = F.col("n"), F.col("i")
    score = phi_inv((i - 0.375) / (n + 0.25))
    placed = placed.withColumn("m", score)
    norms = placed.groupBy("feature").agg(F.sum(F.col("m") * F.col("m")).alias("mm"))
    m1, m2, mm, rn = phi_inv(F.lit(0.625) / (n + 0.25)), phi_inv(F.lit(1.625) / (n + 0.25)), F.col("mm"), 1 / F.sqrt(n)
    a1 = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(_poly(SW_LARGEST, rn) - m1 / F.sqrt(mm))
    a2 = _poly(SW_SECOND, rn) - m2 / F.sqrt(mm)
    fac = F.when(n > 5, F.sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * F.col("a1") * F.col("a1") - 2 * F.col("a2") * F.col("a2")))) \
        .when(n > 3, F.sqrt((mm - 2 * m1 * m1) / (1 - 2 * F.col("a1") * F.col("a1")))).otherwise(F.lit(1.0))
    fit = (norms.join(asked, "feature").withColumn("a1", a1).withColumn("a2", a2).withColumn("fac", fac)
           .select("feature", "a1", "a2", "fac"))
    edge = F.least(i, n + 1 - i)                      # 1 for both ends
    weight = F.when(edge == 1, F.col("a1")).when((edge == 2) & (n > 5), F.col("a2")).otherwise(F.abs(F.col("m")) / F.col("fac"))
    w = (placed.join(F.broadcast(fit), "feature")
         .groupBy("feature").agg(F.sum(F.signum(2 * i - n - 1) * weight * (F.col("v") - F.col("mean"))).alias("num")))
    w = size.join(w, "feature", "left").withColumn(
        "w", F.when(F.col("num").isNotNull(), F.least(F.col("num") * F.col("num") / F.col("ss"), F.lit(1.0))))
    ln = F.log(n)
    y, gamma = F.log(1 - F.col("w")), _poly(SW_GAMMA, n)
    small = (-F.log(gamma - y) - _poly(SW_SMALL_MEAN, n)) / F.exp(_poly(SW_SMALL_SD, n))
    z = F.when(n <= 11, small).otherwise((y - _poly(SW_MEAN, ln)) / F.exp(_poly(SW_SD, ln)))
    three = 6 / math.pi * (F.asin(F.sqrt(F.col("w"))) - math.asin(math.sqrt(0.75)))
    p = (F.when(F.col("w").isNull(), F.lit(None)).when(n == 3, F.greatest(three, F.lit(0.0)))
         .when(F.col("w") == 1, F.lit(1.0)).when((n <= 11) & (y >= gamma), F.lit(0.0)).otherwise(1 - phi(z)))
    return (w.withColumn("shapiro_p", p).select("feature", "n", F.col("w").alias("shapiro_w"), "shapiro_p",
                                                (F.col("shapiro_p") > alpha).alias("is_gaussian")))


# Hierarchy detection ----------------------------------------------------

def hierarchy(df: DataFrame, cols: list[str]) -> DataFrame:
    """First delimiter of ``> / | :`` present in any distinct value -> max
    number of parts and the smallest example; else a letters[_-]digits
    pattern -> 2 levels; else max count > 5 x median count -> 2 levels."""
    counts = category_counts(df, cols)
    delims = [">", "/", "|", ":"]
    aggs = []
    for i, d in enumerate(delims):
        has = F.col("v").contains(d)
        aggs += [F.bool_or(has).alias(f"has{i}"),
                 F.max(F.size(F.split(F.col("v"), "\\" + d if d in "|" else d, -1))).alias(f"lv{i}"),
                 F.min(F.when(has, F.col("v"))).alias(f"ex{i}")]
    pat = F.col("v").rlike(r"[A-Za-z]+[_\-]\d+")
    aggs += [F.bool_or(pat).alias("has_pat"), F.min(F.when(pat, F.col("v"))).alias("ex_pat"),
             F.max("cnt").alias("max_cnt"), F.percentile(F.col("cnt"), 0.5).alias("med_cnt"),
             F.min_by("v", F.struct(-F.col("cnt"), F.col("v"))).alias("top")]
    a = counts.groupBy("feature").agg(*aggs)
    levels, example = F.lit(None).cast("int"), F.lit(None).cast("string")
    freq = F.col("max_cnt") > 5 * F.col("med_cnt")
    levels = F.when(F.col("has_pat"), F.lit(2)).when(freq, F.lit(2)).otherwise(F.lit(0))
    example = F.when(F.col("has_pat"), F.col("ex_pat")).when(freq, F.col("top"))
    for i in reversed(range(len(delims))):
        levels = F.when(F.col(f"has{i}"), F.col(f"lv{i}")).otherwise(levels)
        example = F.when(F.col(f"has{i}"), F.col(f"ex{i}")).otherwise(example)
    return a.select("feature", (levels > 0).alias("has_levels"), levels.alias("levels_detected"),
                    example.alias("example_pattern"))


# Ordinality --------------------------------------------------------------

def ordinality(df: DataFrame, cols: list[str], threshold: float = 0.3) -> DataFrame:
    """All values parse as numbers and the gaps between sorted distinct
    values have std/mean (ddof 0) below ``threshold``."""
    counts = category_counts(df, cols).withColumn("x", F.col("v").try_cast("double"))
    parsed = counts.groupBy("feature").agg(F.bool_and(F.col("x").isNotNull()).alias("all_numeric"))
    gaps = sorted_gaps(counts.filter(F.col("x").isNotNull()), ["feature"], "x").select("feature", F.col("gap").alias("g"))
    gs = gaps.groupBy("feature").agg((F.stddev_pop("g") / F.avg("g")).alias("gap_cv"))
    j = parsed.join(gs, "feature", "left")
    return j.select("feature", "all_numeric", "gap_cv",
                    (F.col("all_numeric") & F.coalesce(F.col("gap_cv") < threshold, F.lit(False))).alias("is_ordinal"))


# Cyclicity ---------------------------------------------------------------

CYCLIC_KEYWORDS = ["month", "day", "day_of_week", "weekday", "season", "hour", "minute"]


def cyclicity(profile: DataFrame) -> DataFrame:
    """Name keyword, or an integer domain inside 1-12 (<=12 distinct),
    0-6 (<=7) or 0-23 (<=24).  Works on B2/B3 output."""
    name = F.lower(F.col("feature"))
    kw = F.lit(False)
    for k in CYCLIC_KEYWORDS:
        kw = kw | name.contains(k)
    u, lo, hi, integer = F.col("unique_count"), F.col("min"), F.col("max"), F.col("is_integer")
    dom = integer & (((u <= 12) & (lo >= 1) & (hi <= 12)) | ((u <= 7) & (lo >= 0) & (hi <= 6))
                     | ((u <= 24) & (lo >= 0) & (hi <= 23)))
    return profile.select("feature", (kw | dom).alias("is_cyclic"))


# Temporal detection -----------------------------------------------------

TEMPORAL_PATTERNS = [r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{4}/\d{2}/\d{2}", r"\d{2}-\d{2}-\d{4}"]


def temporal_detect(df: DataFrame, order_key: str) -> DataFrame:
    """Per column but ``order_key``: timestamp/date type -> temporal; numeric
    -> all values inside the unix-seconds range (1e9, 2e9); text -> every
    non-null value parses, or a tenth of them starts with a date pattern.
    One aggregation over all rows and columns."""
    tests = []
    for f in df.schema.fields:
        if f.name == order_key:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            verdict = F.max(F.lit(True))
        elif isinstance(f.dataType, T.NumericType):
            verdict = (F.min(c) > 1e9) & (F.max(c) < 2e9)
        else:
            s = c.cast("string")
            dated = s.rlike("^(" + "|".join(TEMPORAL_PATTERNS) + ")")
            verdict = (F.coalesce(F.bool_and(F.when(s.isNotNull(), F.try_to_timestamp(s).isNotNull())), F.lit(False))
                       | F.coalesce(F.avg(dated.cast("double")) >= 0.1, F.lit(False)))
        tests.append((f.name, verdict))
    one = df.agg(*[v.alias(f"t{i}") for i, (_, v) in enumerate(tests)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"t{i}").alias("is_temporal"))
                                         for i, (n, _) in enumerate(tests)])))


# Multimodality via binned KDE ---------------------------------------------

def multimodality(df: DataFrame, cols: list[str], grid: int = 1000, bins: int = 2048,
                  peak_height: float = 0.01) -> DataFrame:
    """Gaussian KDE (Scott bandwidth) on a ``grid``-point linspace over
    [min, max]; score = min(1, 0.3 x #local maxima with density >=
    ``peak_height``).  Binned approximation: data are histogrammed into
    ``bins`` equal-width bins and the kernel sum runs over bin centres."""
    long = to_long(df, cols).filter(F.col("v").isNotNull())
    st = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                    F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    width = (F.col("hi") - F.col("lo")) / bins
    hist = (long.join(F.broadcast(st), "feature")
            .withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
            .groupBy("feature", "b").agg(F.count(F.lit(1)).alias("c")))
    hist = hist.join(F.broadcast(st), "feature").select(
        "feature", "c", (F.col("lo") + (F.col("b") + 0.5) * width).alias("xc"), "n", "sd", "lo", "hi")
    h = F.col("sd") * F.pow(F.col("n").cast("double"), -0.2)
    xg = F.col("lo") + F.col("gi") * (F.col("hi") - F.col("lo")) / (grid - 1)
    # bins x grid evaluations per column: fixed size, independent of row count
    dens = (hist.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
            .withColumn("xg", xg)
            .withColumn("k", F.col("c") * F.exp(-0.5 * F.pow((F.col("xg") - F.col("xc")) / h, 2)))
            .groupBy("feature", "gi").agg((F.sum("k") / (F.first("n") * F.first(h) * math.sqrt(2 * math.pi))).alias("d")))
    w = Window.partitionBy("feature").orderBy("gi")
    peaks = dens.select("feature", "d", F.lag("d").over(w).alias("dp"), F.lead("d").over(w).alias("dn")) \
        .filter(F.col("dp").isNotNull() & F.col("dn").isNotNull() & (F.col("d") > F.col("dp"))
                & (F.col("d") > F.col("dn")) & (F.col("d") >= peak_height))
    cnt = peaks.groupBy("feature").agg(F.count(F.lit(1)).alias("n_peaks"))
    out = st.select("feature").join(cnt, "feature", "left").fillna(0, ["n_peaks"])
    score = F.least(F.lit(1.0), F.col("n_peaks") * 0.3)
    return out.select("feature", "n_peaks", score.alias("multimodality_score"), (score > 0.3).alias("is_multimodal"))


# Anderson-Darling A² against a fitted normal ----------------------------

def anderson_darling(df: DataFrame, cols: list[str], n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """A² = -n - (1/n) Σ_j [(2j-1) ln Φ(z_j) + (2n+1-2j) ln(1-Φ(z_j))] over
    sorted z = (x-μ)/σ (σ ddof 1).  The mirrored term is re-indexed so no
    self-join on n+1-j is needed; a tie block at positions a+1..a+c
    contributes its closed-form weight sums."""
    long = to_long(df, cols)
    stats = long.groupBy("feature").agg(F.avg("v").alias("mu"), F.stddev_samp("v").alias("sd"))
    vc = value_counts(long, ["feature"], "v")
    c = cumulative(vc, ["feature"], "v", "cnt", n_buckets).join(F.broadcast(stats), "feature")
    cdf = phi((F.col("v") - F.col("mu")) / F.col("sd"))
    a = (F.col("cum_cnt") - F.col("cnt")).cast("double")
    cc = F.col("cnt").cast("double")
    n = F.col("tot_cnt").cast("double")
    w1 = (a + cc) * (a + cc) - a * a
    w2 = cc * (2 * n + 1) - ((a + cc) * (a + cc + 1) - a * (a + 1))
    term = w1 * F.log(cdf) + w2 * F.log(1.0 - cdf)
    s = c.groupBy("feature").agg(F.sum(term).alias("s"), F.first("tot_cnt").alias("n"))
    return s.select("feature", (-F.col("n") - F.col("s") / F.col("n")).alias("anderson_statistic"))
