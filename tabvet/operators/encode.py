"""Encoding and decoding of columns.

Pattern everywhere: ``fit`` runs one or two aggregations and collects
only fitted parameters (one row per column, or a bounded category list
whose size is checked first); ``transform`` / ``inverse`` are a single
``select`` of Column expressions that Catalyst codegens.  Dictionaries
that can grow with the data (label codes, target/frequency encodings)
are joined back, with a broadcast only below a checked row count.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.session import sized
from tabvet.functions.hashing import normal_draw
from tabvet.functions.normal import phi, phi_inv
from tabvet.operators.profile import quantiles, to_long
from tabvet.operators.ranks import cumulative, with_const_array

MISSING = "__MISSING__"
MAX_ONEHOT = 50


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _num(df: DataFrame, c: str) -> Column:
    """Value as double; text that does not parse -> NULL; NaN -> NULL."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.StringType):
        x = _c(c).try_cast("double")
    else:
        x = _c(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def _join_small(df: DataFrame, side: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a fitted dictionary: broadcast only after checking its size."""
    return df.join(sized(side), on, how)


# ---------------------------------------------------------------------------
# Continuous columns
# ---------------------------------------------------------------------------

class ContinuousEncoder:
    """Median imputation (fitted once) + scaling.

    scaling: ``robust`` (x - median) / (P95 - P5); ``standard``
    (x - mean) / std_pop; ``minmax`` to [-1, 1]; ``none``.  Zero scales
    become 1.  Statistics are those of the imputed column, as the scaler
    is fitted after imputation.
    """

    def __init__(self, cols: list[str], scaling: str = "robust"):
        self.cols, self.scaling = list(cols), scaling
        self.params: dict[str, dict] = {}

    def fit(self, df: DataFrame) -> "ContinuousEncoder":
        clean = df.select(*[_num(df, c).alias(c) for c in self.cols])
        long = to_long(clean, self.cols)
        nulls = {r["feature"]: r["n"] for r in long.groupBy("feature").agg(
            F.count_if(F.col("v").isNull()).alias("n")).collect()}
        probs = [0.05, 0.5, 0.95] if self.scaling == "robust" else [0.5]
        # one quantile pass gives the median and, for columns without NULLs
        # (imputation changes nothing), the robust range as well
        q0: dict = {c: {} for c in self.cols}
        for r in quantiles(long, ["feature"], "v", probs).collect():
            q0[r["feature"]][r["p"]] = r["q"]
        med = {c: (float(q0[c][0.5]) if q0[c].get(0.5) is not None else 0.0) for c in self.cols}
        imputed = clean.select(*[F.coalesce(_c(c), F.lit(med[c])).alias(c) for c in self.cols])
        il = to_long(imputed, self.cols)
        mom = {r["feature"]: r for r in il.groupBy("feature").agg(
            F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
            F.min("v").alias("min"), F.max("v").alias("max")).collect()}
        qs: dict = {c: dict(q0[c]) for c in self.cols}
        with_nulls = [c for c in self.cols if nulls.get(c, 0) > 0]
        if self.scaling == "robust" and with_nulls:
            for r in quantiles(to_long(imputed.select(*with_nulls), with_nulls), ["feature"], "v",
                               [0.05, 0.95]).collect():
                qs[r["feature"]][r["p"]] = r["q"]
        for c in self.cols:
            m = mom[c]
            p = {"median": med[c], "mean": m["mean"], "std": m["std"], "min": m["min"], "max": m["max"]}
            if self.scaling == "robust":
                p["center"] = med[c]
                rng = qs[c][0.95] - qs[c][0.05]
                p["scale"] = rng if rng != 0 else 1.0
            elif self.scaling == "standard":
                p["center"], p["scale"] = m["mean"], (m["std"] if m["std"] else 1.0)
            elif self.scaling == "minmax":
                rng = m["max"] - m["min"]
                rng = rng if rng != 0 else 1.0
                # x' = (x - min) / rng * 2 - 1  ==  (x - center) / scale
                p["center"], p["scale"] = m["min"] + rng / 2.0, rng / 2.0
            else:
                p["center"], p["scale"] = 0.0, 1.0
            self.params[c] = p
        return self

    def transform_columns(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c in self.cols:
            p = self.params[c]
            x = F.coalesce(_num(df, c), F.lit(p["median"]))
            out[c] = (x - F.lit(p["center"])) / F.lit(p["scale"])
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        t = self.transform_columns(df)
        return df.select(*[(t[c].alias(c) if c in t else _c(c)) for c in df.columns])

    def inverse(self, df: DataFrame) -> DataFrame:
        """x = z * scale + center; an absent encoded column decodes zeros."""
        cols = []
        for c in self.cols:
            p = self.params[c]
            z = _c(c).cast("double") if c in df.columns else F.lit(0.0)
            cols.append((z * F.lit(p["scale"]) + F.lit(p["center"])).alias(c))
        rest = [_c(c) for c in df.columns if c not in self.cols]
        return df.select(*rest, *cols)


# ---------------------------------------------------------------------------
# Categorical columns
# ---------------------------------------------------------------------------

def _cat_text(c: str) -> Column:
    return F.coalesce(_c(c).cast("string"), F.lit(MISSING))


class OneHotEncoder:
    """Sorted categories of the text form (NULL -> '__MISSING__'); columns
    ``{col}_{i}``; an unseen value encodes as all zeros.  A column of more
    than ``max_categories`` gets one column ``{col}_code`` of label codes."""

    def __init__(self, cols: list[str], max_categories: int = MAX_ONEHOT):
        self.cols, self.max_categories = list(cols), max_categories
        self.categories: dict[str, list[str]] = {}
        self.coded: dict[str, LabelEncoder] = {}

    def fit(self, df: DataFrame) -> "OneHotEncoder":
        cats = df.select(*[_cat_text(c).alias(c) for c in self.cols])
        long = cats.unpivot([], self.cols, "feature", "v").distinct()
        sizes = {r["feature"]: r["k"] for r in long.groupBy("feature").agg(F.count(F.lit(1)).alias("k")).collect()}
        self.coded = {c: LabelEncoder(c).fit(df) for c, k in sizes.items() if k > self.max_categories}
        for r in long.filter(~F.col("feature").isin(list(self.coded))).groupBy("feature").agg(F.array_sort(F.collect_list("v")).alias("cats")).collect():
            self.categories[r["feature"]] = list(r["cats"])
        return self

    def transform_columns(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for c in self.categories:
            v = _cat_text(c)
            for i, cat in enumerate(self.categories[c]):
                out[f"{c}_{i}"] = F.when(v == F.lit(cat), F.lit(1.0)).otherwise(F.lit(0.0))
        return out

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = keep if keep is not None else [c for c in df.columns if c not in self.cols]
        for c, le in self.coded.items():
            df = le.transform(df, f"{c}_code")
        t = self.transform_columns(df)
        return df.select(*[_c(k) for k in keep], *[v.alias(k) for k, v in t.items()],
                         *[_c(f"{c}_code") for c in self.coded])

    def inverse(self, df: DataFrame, default: str = MISSING) -> DataFrame:
        """First argmax of the one-hot block; all-zero rows decode NULL;
        a block absent from the table decodes to ``default``."""
        out = []
        used = set()
        for c, le in self.coded.items():
            if f"{c}_code" in df.columns:
                df = le.inverse(df, f"{c}_code").drop(f"{c}_code")
        for c in self.cols:
            if c in self.coded:
                if c not in df.columns:
                    out.append(F.lit(default).alias(c))
                continue
            names = [f"{c}_{i}" for i in range(len(self.categories[c]))]
            present = [n for n in names if n in df.columns]
            if not present:
                out.append(F.lit(default).alias(c))
                continue
            used.update(present)
            arr = F.array(*[_c(n).cast("double") for n in names if n in df.columns])
            cats = F.array(*[F.lit(self.categories[c][i]) for i, n in enumerate(names) if n in df.columns])
            pos = F.array_position(arr, F.array_max(arr))
            out.append(F.when(F.array_max(arr) > 0, F.element_at(cats, pos.cast("int"))).alias(c))
        rest = [_c(n) for n in df.columns if n not in used]
        return df.select(*rest, *out)


class LabelEncoder:
    """Code = 0-based rank of the sorted distinct text value.  The
    dictionary is built with the prefix-sum kernel (no single-partition
    window) and joined back with a size-checked broadcast; an unseen value
    encodes as NULL."""

    def __init__(self, col: str, order: list | None = None):
        self.col, self.order = col, order
        self.dictionary: DataFrame | None = None

    def fit(self, df: DataFrame) -> "LabelEncoder":
        if self.order is not None:
            return self
        d = df.select(_cat_text(self.col).alias("v")).distinct().withColumn("cnt", F.lit(1))
        c = cumulative(d, [], "v", "cnt")
        self.dictionary = c.select("v", (F.col("cum_cnt") - 1).alias("code"))
        return self

    def transform(self, df: DataFrame, out_col: str | None = None) -> DataFrame:
        out_col = out_col or self.col
        if self.order is not None:
            # Explicit order
            arr = F.array(*[F.lit(str(o)) for o in self.order])
            code = F.array_position(arr, _cat_text(self.col)) - 1
            return df.withColumn(out_col, F.when(code >= 0, code))
        j = _join_small(df.withColumn("_v", _cat_text(self.col)),
                        self.dictionary.withColumnRenamed("v", "_v"), "_v")
        cols = [c for c in df.columns if c != out_col]
        return j.select(*[_c(c) for c in cols], F.col("code").alias(out_col))

    def inverse(self, df: DataFrame, code_col: str | None = None) -> DataFrame:
        code_col = code_col or self.col
        if self.order is not None:
            arr = F.array(*[F.lit(str(o)) for o in self.order])
            return df.withColumn(self.col, F.element_at(arr, (_c(code_col).cast("int") + 1)))
        d = self.dictionary.withColumnRenamed("code", "_code")
        j = _join_small(df.withColumn("_code", _c(code_col).cast("long")), d, "_code")
        cols = [c for c in df.columns if c != self.col]
        return j.select(*[_c(c) for c in cols], F.col("v").alias(self.col))


# ---------------------------------------------------------------------------
# datetime
# ---------------------------------------------------------------------------

def _ts(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def datetime_parts(df: DataFrame, col: str) -> dict[str, Column]:
    """Year, month, day, hour, dayofweek (Mon=0), is_weekend; NULL
    timestamps default to 2020/1/1/0/0/0."""
    t = _ts(_c(col)) if not isinstance(df.schema[col].dataType, T.StringType) else F.try_to_timestamp(_c(col))
    dow = F.weekday(t)
    return {
        f"{col}_year": F.coalesce(F.year(t), F.lit(2020)),
        f"{col}_month": F.coalesce(F.month(t), F.lit(1)),
        f"{col}_day": F.coalesce(F.dayofmonth(t), F.lit(1)),
        f"{col}_hour": F.coalesce(F.hour(t), F.lit(0)),
        f"{col}_dayofweek": F.coalesce(dow, F.lit(0)),
        f"{col}_is_weekend": F.coalesce((dow >= 5).cast("int"), F.lit(0)),
    }


class DatetimeEncoder:
    """D10 + D11: components, then z-scores with ddof-1 std + 1e-8 fitted
    once and kept for the inverse (D12)."""

    def __init__(self, col: str):
        self.col = col
        self.stats: dict[str, tuple[float, float]] = {}

    def fit(self, df: DataFrame) -> "DatetimeEncoder":
        parts = datetime_parts(df, self.col)
        row = df.select(*[v.alias(k) for k, v in parts.items()]).agg(
            *[F.avg(k).alias(f"m_{k}") for k in parts], *[F.stddev_samp(k).alias(f"s_{k}") for k in parts]).first()
        for k in parts:
            s = row[f"s_{k}"]
            self.stats[k] = (row[f"m_{k}"], (s if s is not None and not math.isnan(s) else 0.0) + 1e-8)
        return self

    def transform_columns(self, df: DataFrame) -> dict[str, Column]:
        parts = datetime_parts(df, self.col)
        return {k: (v - F.lit(self.stats[k][0])) / F.lit(self.stats[k][1]) for k, v in parts.items()}

    def transform(self, df: DataFrame) -> DataFrame:
        t = self.transform_columns(df)
        return df.select(*[_c(c) for c in df.columns if c != self.col], *[v.alias(k) for k, v in t.items()])

    def inverse(self, df: DataFrame) -> DataFrame:
        """De-normalise with the fitted statistics, truncate, clip month
        1-12, day 1-28, hour 0-23; missing components -> 2020-01-01."""
        names = {p: f"{self.col}_{p}" for p in ("year", "month", "day", "hour")}
        if any(n not in df.columns for n in names.values()):
            return df.withColumn(self.col, F.lit("2020-01-01 00:00:00").cast("timestamp_ntz"))

        def comp(p):
            m, s = self.stats[names[p]]
            # astype(int) truncates toward zero; the de-normalised value is
            # rounded to 1e-6 first so float noise cannot drop a whole unit
            return F.round(_c(names[p]) * F.lit(s) + F.lit(m), 6).cast("int")

        y = comp("year")
        mo = F.least(F.greatest(comp("month"), F.lit(1)), F.lit(12))
        d = F.least(F.greatest(comp("day"), F.lit(1)), F.lit(28))
        h = F.least(F.greatest(comp("hour"), F.lit(0)), F.lit(23))
        ts = F.try_make_timestamp_ntz(y, mo, d, h, F.lit(0), F.lit(0)) \
            if hasattr(F, "try_make_timestamp_ntz") else F.make_timestamp_ntz(y, mo, d, h, F.lit(0), F.lit(0))
        return df.withColumn(self.col, ts)


def parse_temporal(df: DataFrame, col: str) -> Column:
    """Numeric -> unix seconds; text -> lenient parse; bad -> NULL."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.NumericType):
        return F.timestamp_micros((_c(col).cast("double") * 1_000_000).cast("long")).cast("timestamp_ntz")
    if isinstance(dt, T.StringType):
        return F.try_to_timestamp(_c(col)).cast("timestamp_ntz")
    return _c(col).cast("timestamp_ntz")


def cyclical_time(df: DataFrame, col: str, prefix: str = "") -> DataFrame:
    """hour/24, dow/7, month/12, doy/365 sin & cos; NULL -> median
    timestamp (linear interpolation of epoch microseconds); all NULL ->
    2000-01-01."""
    t = parse_temporal(df, col)
    base = df.withColumn("_t", t)
    micros = F.unix_micros(F.col("_t").cast("timestamp"))
    med = quantiles(base.select(micros.cast("double").alias("m")), [], "m", [0.5]).collect()
    if med and med[0]["q"] is not None:
        fill = F.timestamp_micros(F.lit(int(round(med[0]["q"])))).cast("timestamp_ntz")
    else:
        fill = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    tc = F.coalesce(F.col("_t"), fill)
    two_pi = 2 * math.pi
    comps = {"hour": (F.hour(tc), 24.0), "dow": (F.weekday(tc), 7.0), "month": (F.month(tc), 12.0),
             "doy": (F.dayofyear(tc), 365.0)}
    cols = []
    for k, (v, period) in comps.items():
        cols.append(F.sin(two_pi * v / period).alias(f"{prefix}{k}_sin"))
        cols.append(F.cos(two_pi * v / period).alias(f"{prefix}{k}_cos"))
    return base.select(*[_c(c) for c in df.columns], *cols)


def sincos(c: Column, period: float, name: str) -> list[Column]:
    """sin/cos(2π x / period)."""
    a = 2 * math.pi * c.cast("double") / F.lit(float(period))
    return [F.sin(a).alias(f"{name}_sin"), F.cos(a).alias(f"{name}_cos")]


# ---------------------------------------------------------------------------
# Hashing, target / frequency, binary, dummies
# ---------------------------------------------------------------------------

def _hash_position(c: Column, n: int) -> Column:
    """md5(text) as a 128-bit integer, modulo 2n: folded 7 hex digits at a
    time, so that no product leaves 64 bits."""
    h = F.md5(c.cast("string"))
    r = F.lit(0).cast("long")
    for at in range(1, 33, 7):
        digits = min(7, 33 - at)
        part = F.conv(F.substring(h, at, digits), 16, 10).cast("long")
        r = (r * (16 ** digits % (2 * n)) + part) % (2 * n)
    return r


def hash_bucket(c: Column, n: int) -> tuple[Column, Column]:
    """(index, sign) of md5(text) as a 128-bit integer H: index = H mod n,
    sign = +1 if (H div n) is even else -1."""
    r = _hash_position(c, n)
    return r % n, F.when(r < n, F.lit(1.0)).otherwise(F.lit(-1.0))


def feature_hashing(df: DataFrame, col: str, n: int = 32) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with the text's position, found once a row, and the
    ``{col}_hash_{i}`` columns over it; NULL rows are all zeros."""
    at = f"_{col}_position"
    r = _c(at)
    placed = df.withColumn(at, F.when(_c(col).isNotNull(), _hash_position(_c(col), n)))
    return placed, {f"{col}_hash_{i}": F.when(r == i, F.lit(1.0)).when(r == i + n, F.lit(-1.0)).otherwise(F.lit(0.0))
                    for i in range(n)}


def target_encoding(df: DataFrame, col: str, target: str, smoothing: float = 10.0,
                    out_col: str | None = None) -> DataFrame:
    """(Σy + m ȳ) / (n + m) per category; unseen / NULL -> ȳ."""
    out_col = out_col or f"{col}_target_enc"
    y = _c(target).cast("double")
    gm = df.agg(F.avg(y).alias("gm")).first()["gm"]
    stats = (df.filter(_c(col).isNotNull() & y.isNotNull()).groupBy(_c(col).alias("_k"))
             .agg(F.sum(y).alias("_s"), F.count(y).alias("_n")))
    enc = stats.select("_k", ((F.col("_s") + smoothing * gm) / (F.col("_n") + smoothing)).alias("_e"))
    j = _join_small(df.withColumn("_k", _c(col)), enc, "_k")
    return j.withColumn(out_col, F.coalesce(F.col("_e"), F.lit(gm))).drop("_k", "_e")


def frequency_encoding(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """Share of the value among non-null values; NULL -> 0."""
    out_col = out_col or f"{col}_freq"
    counts = df.filter(_c(col).isNotNull()).groupBy(_c(col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    tot = df.filter(_c(col).isNotNull()).count()
    enc = counts.select("_k", (F.col("_n") / F.lit(float(max(tot, 1)))).alias("_f"))
    j = _join_small(df.withColumn("_k", _c(col)), enc, "_k")
    return j.withColumn(out_col, F.coalesce(F.col("_f"), F.lit(0.0))).drop("_k", "_f")


def binary_encoding(df: DataFrame, col: str) -> Column:
    """Smaller value -> 0, larger -> 1 (deterministic order instead of
    first-seen order), NULL -> 0."""
    lo = df.agg(F.min(_c(col)).alias("lo")).first()["lo"]
    return F.when(_c(col).isNull(), F.lit(0.0)).when(_c(col) == F.lit(lo), F.lit(0.0)).otherwise(F.lit(1.0))


def dummies(df: DataFrame, col: str, max_values: int = MAX_ONEHOT) -> dict[str, Column]:
    """``{col}_{value}`` indicator columns over sorted distinct
    values (count checked first); NULL rows all zero."""
    d = df.select(_c(col).cast("string").alias("v")).filter(F.col("v").isNotNull()).distinct()
    if d.count() > max_values:
        raise ValueError(f"too many values for dummies in {col}")
    vals = sorted(r["v"] for r in d.collect())
    s = _c(col).cast("string")
    return {f"{col}_{v}": F.when(s == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)) for v in vals}


# ---------------------------------------------------------------------------
# Distribution transforms and numeric stability
# ---------------------------------------------------------------------------

def _count_below(arr: Column, x: Column, inclusive: bool = False) -> Column:
    """Number of elements of the sorted array ``arr`` below x (or <= x):
    binary search in 14 steps (arrays up to 16384)."""
    def step(acc, _i):
        mid = ((acc["lo"] + acc["hi"]) / 2).cast("int")
        e = F.try_element_at(arr, mid + 1)
        go_right = (e <= x) if inclusive else (e < x)
        return F.when(acc["lo"] < acc["hi"],
                      F.when(go_right, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi")))
                      .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))).otherwise(acc)
    init = F.struct(F.lit(0).alias("lo"), F.size(arr).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), init, step, lambda acc: acc["lo"])


class QuantileGaussian:
    """Quantile -> standard-normal transform with up to 1000
    quantiles.  Re-aim: exact quantiles of the full column (the reference
    library subsamples 10 000 rows)."""

    BOUND = 1e-7
    CLIP = 5.199337582187471

    def __init__(self, col: str, n_quantiles: int = 1000):
        self.col, self.n_quantiles = col, n_quantiles
        self.q: list[float] = []

    def fit(self, df: DataFrame) -> "QuantileGaussian":
        x = df.select(_num(df, self.col).alias("x")).filter(F.col("x").isNotNull())
        n = x.count()
        k = max(2, min(self.n_quantiles, n))
        probs = [i / (k - 1) for i in range(k)]
        rows = quantiles(x, [], "x", probs).collect()
        qmap = {r["p"]: r["q"] for r in rows}
        self.q = [float(qmap[p]) for p in probs]
        return self

    def with_quantiles(self, df: DataFrame) -> DataFrame:
        """Attach the fitted quantile array as column ``_qg`` (one-row
        broadcast join); ``transform_column`` / ``inverse_column`` use it."""
        return with_const_array(df, "_qg", self.q)

    def transform(self, df: DataFrame, out_col: str) -> DataFrame:
        """Add ``out_col`` = Φ⁻¹ of the interpolated CDF, clipped at ±5.1993.
        Intermediates are separate projections: each is referenced several
        times downstream and must not be duplicated into the expression."""
        k = len(self.q)
        d = self.with_quantiles(df).withColumn("_x", _num(df, self.col))
        q, x = F.col("_qg"), F.col("_x")
        d = d.withColumn("_l", _count_below(q, x)).withColumn("_r", _count_below(q, x, True) - 1)
        left, right = F.col("_l"), F.col("_r")
        ref = lambda i: i.cast("double") / (k - 1)
        qa, qb = F.try_element_at(q, right + 1), F.try_element_at(q, left + 1)
        interp = ref(right) + (x - qa) * (ref(left) - ref(right)) / (qb - qa)
        y = F.when(left <= right, (ref(left) + ref(right)) / 2.0).otherwise(interp)
        y = (F.when(x - self.BOUND < F.lit(self.q[0]), F.lit(0.0))
             .when(x + self.BOUND > F.lit(self.q[-1]), F.lit(1.0)).otherwise(y))
        d = d.withColumn("_y", y)
        z = phi_inv(F.col("_y"))
        d = d.withColumn(out_col, F.when(x.isNull(), F.lit(None).cast("double"))
                         .otherwise(F.least(F.greatest(z, F.lit(-self.CLIP)), F.lit(self.CLIP))))
        return d.drop("_qg", "_x", "_l", "_r", "_y")

    def inverse(self, df: DataFrame, z_col: str, out_col: str, dtype: str = "double") -> DataFrame:
        """Add ``out_col`` = quantile interpolation of Φ(z)."""
        k = len(self.q)
        d = self.with_quantiles(df)
        d = d.withColumn("_p", phi(F.least(F.greatest(F.col(z_col).cast("double"), F.lit(-self.CLIP)),
                                           F.lit(self.CLIP))) * (k - 1))
        pos = F.col("_p")
        j = F.least(F.floor(pos).cast("int"), F.lit(k - 2))
        q = F.col("_qg")
        qa, qb = F.element_at(q, j + 1), F.element_at(q, j + 2)
        return d.withColumn(out_col, (qa + (pos - j) * (qb - qa)).cast(dtype)).drop("_qg", "_p")


def boxcox_lambda(df: DataFrame, col: str, offset: float = 1.0, lo: float = -5.0, hi: float = 5.0,
                  steps: int = 41, rounds: int = 6) -> float:
    """MLE λ of Box-Cox(x + offset).  llf(λ) = (λ-1) Σ ln x - n/2 ln
    var_pop(y_λ); var of y_λ = (x^λ - 1)/λ needs only Σ x^λ and Σ x^{2λ},
    so each refinement round is one pass computing a grid of moments.
    Re-aimed optimiser: grid refinement instead of Brent's method."""
    x = (_num(df, col) + F.lit(offset))
    base = df.select(x.alias("x")).filter(F.col("x") > 0)
    agg = base.agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("x")).alias("sl"), F.avg(F.log("x")).alias("ml")).first()
    n, sl, ml = agg["n"], agg["sl"], agg["ml"]
    # Σ (ln x - ml) and Σ (ln x - ml)² for the λ = 0 (log) case
    lg = base.agg(F.sum(F.log("x") - F.lit(ml)).alias("a"), F.sum((F.log("x") - F.lit(ml)) ** 2).alias("b")).first()
    best = 1.0
    for _ in range(rounds):
        grid = [lo + (hi - lo) * i / (steps - 1) for i in range(steps)]
        # x^λ = e^{λ ml} e^{λ (ln x - ml)}: centring on the mean log keeps the
        # powers well scaled; all grid moments come from one aggregation
        u = [F.exp(F.lit(float(g)) * (F.log("x") - F.lit(ml))) for g in grid]
        row = base.agg(*[F.sum(v).alias(f"s1_{i}") for i, v in enumerate(u)],
                       *[F.sum(v * v).alias(f"s2_{i}") for i, v in enumerate(u)]).first()
        best_llf = -math.inf
        for i, lam in enumerate(grid):
            if abs(lam) < 1e-12:
                var = lg["b"] / n - (lg["a"] / n) ** 2
            else:
                var_u = row[f"s2_{i}"] / n - (row[f"s1_{i}"] / n) ** 2
                var = var_u * math.exp(2 * lam * ml) / (lam * lam)
            if not var > 0:
                continue
            llf = (lam - 1) * sl - n / 2.0 * math.log(var)
            if llf > best_llf:
                best_llf, best = llf, lam
        width = (hi - lo) / (steps - 1)
        lo, hi = best - 2 * width, best + 2 * width
    return best


def boxcox(c: Column, lam: float, offset: float = 1.0) -> Column:
    x = c.cast("double") + F.lit(offset)
    if abs(lam) < 1e-12:
        return F.log(x)
    return (F.pow(x, F.lit(lam)) - 1.0) / F.lit(lam)


def log_offset(c: Column, offset: float = 1.0) -> Column:
    """log(x + offset)."""
    return F.log(c.cast("double") + F.lit(offset))


def impute_nonfinite(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN / ±inf / NULL -> median of the finite values."""
    finite = df.select(*[F.when(~_c(c).cast("double").isin(float("inf"), float("-inf")),
                                 F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))).alias(c) for c in cols])
    med = {r["feature"]: r["q"] for r in quantiles(to_long(finite, cols), ["feature"], "v", [0.5]).collect()}
    out = {}
    for c in cols:
        x = _c(c).cast("double")
        # NaN is above infinity; a short condition, since code of many columns is compiled as one method
        out[c] = F.when(F.abs(x) < float("inf"), x).otherwise(F.lit(med.get(c)))
    return df.select(*[(out[c].alias(c) if c in out else _c(c)) for c in df.columns])


def variance_guard(df: DataFrame, cols: list[str], key: str, tol: float = 1e-10, seed: int = 42) -> DataFrame:
    """Columns whose sample variance is below ``tol`` get N(0, σ_j)
    jitter, σ_j = max(sqrt(tol)·10, 100·sd, 1e-6), drawn from hash
    uniforms of (seed, column, key) so re-execution is identical."""
    row = df.agg(*[F.var_samp(_c(c).cast("double")).alias(c) for c in cols]).first()
    out = {}
    for c in cols:
        v = row[c] or 0.0
        if v > tol:
            continue
        sd = math.sqrt(v) if v > 0 else 0.0
        mag = max(math.sqrt(tol) * 10, sd * 100, 1e-6)
        out[c] = _c(c).cast("double") + F.lit(mag) * normal_draw(f"{seed}:{c}", key)
    return df.select(*[(out[c].alias(c) if c in out else _c(c)) for c in df.columns])


def covariance(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sample covariance matrix (d x d) from one aggregation."""
    aggs = [F.covar_samp(_c(a).cast("double"), _c(b).cast("double")).alias(f"c{i}_{j}")
            for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    row = df.agg(*aggs).first()
    d = len(cols)
    m = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            m[i, j] = m[j, i] = row[f"c{i}_{j}"] or 0.0
    return m


def pca_projection(df: DataFrame, cols: list[str], n_components: int = 1, prefix: str = "pc") -> DataFrame:
    """Robust-scale (median, IQR) with NULL -> 0, covariance by one
    aggregation, d x d eigen-decomposition on the driver, projection as a
    Column.  One column passes through.  Sign: largest |loading| positive."""
    filled = df.select(*[F.coalesce(_c(c).cast("double"), F.lit(0.0)).alias(c) for c in cols])
    if len(cols) == 1:
        return filled.select(F.col(cols[0]).alias(f"{prefix}0"))
    qs: dict = {c: {} for c in cols}
    for r in quantiles(to_long(filled, cols), ["feature"], "v", [0.25, 0.5, 0.75]).collect():
        qs[r["feature"]][r["p"]] = r["q"]
    scaled = filled.select(*[((F.col(c) - F.lit(qs[c][0.5]))
                              / F.lit((qs[c][0.75] - qs[c][0.25]) or 1.0)).alias(c) for c in cols])
    cov = covariance(scaled, cols)
    w, v = np.linalg.eigh(cov)
    order = np.argsort(w)[::-1][:min(n_components, len(cols))]
    means = scaled.agg(*[F.avg(c).alias(c) for c in cols]).first()
    out = []
    for k, idx in enumerate(order):
        vec = v[:, idx]
        if vec[np.argmax(np.abs(vec))] < 0:
            vec = -vec
        expr = sum((F.col(c) - F.lit(means[c])) * F.lit(float(vec[i])) for i, c in enumerate(cols))
        out.append(expr.alias(f"{prefix}{k}"))
    return scaled.select(*out)


def numerical_health(df: DataFrame, cols: list[str], tol: float = 1e-10) -> DataFrame:
    """#NaN, #inf, min sample variance, condition number of cov +
    1e-6 I (d x d on the driver) and the four guarantees.  Counts stay a
    lazy aggregate; only the d x d covariance is collected."""
    nan = sum(F.count_if(_c(c).cast("double").isNull() | F.isnan(_c(c).cast("double"))) for c in cols)
    inf = sum(F.count_if(_c(c).cast("double").isin(float("inf"), float("-inf"))) for c in cols)
    var = F.least(*[F.coalesce(F.var_samp(_c(c).cast("double")), F.lit(0.0)) for c in cols]) \
        if len(cols) > 1 else F.coalesce(F.var_samp(_c(cols[0]).cast("double")), F.lit(0.0))
    cov = covariance(df, cols)
    cond = float(np.linalg.cond(cov + np.eye(len(cols)) * 1e-6)) if np.all(np.isfinite(cov)) else float("inf")
    a = df.agg(nan.cast("double").alias("n_nan"), inf.cast("double").alias("n_inf"), var.alias("min_variance"))
    return a.select("n_nan", "n_inf", "min_variance", F.lit(cond).alias("condition_number"),
                    (F.col("n_nan") == 0).alias("no_nan"), (F.col("n_inf") == 0).alias("no_inf"),
                    (F.col("min_variance") > tol).alias("stable_variance"),
                    F.lit(cond < 1e10).alias("stable_covariance"))


# ---------------------------------------------------------------------------
# D30, D32
# ---------------------------------------------------------------------------

def sanitize_name_col(c: Column) -> Column:
    """Names as identifiers, for a table of names: what is neither letter
    nor digit becomes one '_' a run, none at either end; a digit in front
    gets 'f_' before it; nothing left is 'unnamed_feature'."""
    s = F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]", "_"), "_+", "_")
    s = F.when(F.substring(s, 1, 1).rlike("[0-9]"), F.concat(F.lit("f_"), s)).otherwise(s)
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when((c.isNull()) | (c == ""), F.lit("unnamed_feature")).otherwise(s)


def layout(schema: DataFrame) -> DataFrame:
    """(feature, position, output_dim) -> start / end offsets of each
    encoded block (a running sum over the small schema table)."""
    from pyspark.sql import Window
    w = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("output_dim").over(w)
    return schema.select("feature", "position", "output_dim", (end - F.col("output_dim")).alias("start"),
                         end.alias("end"))


# ---------------------------------------------------------------------------
# Fit / transform / inverse of a whole table by routed type
# ---------------------------------------------------------------------------

class TableEncoder:
    """Encode every column by its inferred schema (C4): continuous -> median
    imputation + robust scaling; categorical -> one-hot below 25 values,
    else label codes; datetime -> z-scored calendar components.  ``fit``
    runs the encoders' aggregations; ``transform`` is one projection plus
    the (size-checked) label-dictionary joins; the output column order
    follows the schema, not completion order."""

    def __init__(self, schema_rows: list[tuple[str, str, str | None]]):
        self.schema = list(schema_rows)
        self.cont: ContinuousEncoder | None = None
        self.onehot: OneHotEncoder | None = None
        self.labels: dict[str, LabelEncoder] = {}
        self.dates: dict[str, DatetimeEncoder] = {}

    @classmethod
    def infer(cls, df: DataFrame, cols: list[str]) -> "TableEncoder":
        from tabvet.operators.typing import feature_schema
        rows = {r["feature"]: (r["feature_type"], r["encoding"]) for r in feature_schema(df, cols).collect()}
        return cls([(c, rows[c][0], rows[c][1]) for c in cols])

    def fit(self, df: DataFrame) -> "TableEncoder":
        cont = [c for c, t, _ in self.schema if t == "continuous"]
        oh = [c for c, t, e in self.schema if t == "categorical" and e == "onehot"]
        if cont:
            self.cont = ContinuousEncoder(cont, "robust").fit(df)
        if oh:
            self.onehot = OneHotEncoder(oh).fit(df)
        for c, t, e in self.schema:
            if t == "categorical" and e != "onehot":
                self.labels[c] = LabelEncoder(c).fit(df)
            elif t == "datetime":
                self.dates[c] = DatetimeEncoder(c).fit(df)
        return self

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = keep or []
        cont = self.cont.transform_columns(df) if self.cont else {}
        oh = self.onehot.transform_columns(df) if self.onehot else {}
        out = [F.col(k) for k in keep]
        for c, t, e in self.schema:
            if t == "continuous":
                out.append(cont[c].alias(c))
            elif t == "categorical" and e == "onehot":
                out += [v.alias(n) for n, v in oh.items() if n.startswith(f"{c}_")
                        and n[len(c) + 1:].isdigit()]
            elif t == "datetime":
                out += [v.alias(n) for n, v in self.dates[c].transform_columns(df).items()]
            else:
                out.append(_c(c))
        res = df.select(*out)
        for c, le in self.labels.items():
            res = le.transform(res)
        return res


    def inverse_transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """The columns back from their encodings, in schema order: scaled
        numbers (imputed ones as the median), categories as text (NULL as
        '__MISSING__'), dates as timestamps."""
        keep = keep or []
        out = self.cont.inverse(df) if self.cont else df
        if self.onehot:
            out = self.onehot.inverse(out)
        for c, le in self.labels.items():
            out = le.inverse(out)
        for c, de in self.dates.items():
            out = de.inverse(out)
        return out.select(*keep, *[_c(c) for c, _, _ in self.schema])


# ---------------------------------------------------------------------------
# The preparation pipeline routed by semantic type
# ---------------------------------------------------------------------------

def prepare(df: DataFrame, cols: list[str], key: str, target: str | None = None, hash_components: int = 32,
            id_hash_max: int = 10_000, categorical_max: int = 50, high_cardinality: int = 100,
            tol: float = 1e-10, balance: tuple[str, object] | None = None) -> tuple[DataFrame, DataFrame]:
    """Semantic type (C3) per column, then: INVARIANT dropped; IDENTIFIER
    hashed (fewer than 10 000 values) or dropped; TEMPORAL -> 8 cyclical
    columns; BINARY -> 0/1; CATEGORICAL -> target encoding above 100
    values with a target (hashing without), frequency/target encoding above
    50, dummies below; CONTINUOUS -> non-finite imputation and the variance
    guard.  Finally NULL / ±inf -> 0.  ``balance`` = (class column, minority
    value) resamples the prepared table by SMOTE (K6): the class column is
    kept and ``synthetic`` marks the added rows.  Returns (prepared table, report with
    one row per input column: semantic type, cardinality, transformation,
    output dimensions, warning)."""
    from tabvet.operators.typing import column_facts, semantic_types
    st = {r["feature"]: r["semantic_type"] for r in semantic_types(df, cols).collect()}
    facts = {r["feature"]: r for r in column_facts(df, cols).collect()}
    out_cols: list = [F.col(key)]
    report = []
    frame = placed = df
    joins = []
    for c in cols:
        t = st[c]
        card = facts[c]["unique_count"] or 0
        if t == "INVARIANT":
            report.append((c, t, card, "dropped", 0, f"Dropped invariant column: {c}"))
        elif t == "IDENTIFIER":
            if card < id_hash_max:
                placed, h = feature_hashing(placed, c, hash_components)
                out_cols += [v.alias(n) for n, v in h.items()]
                report.append((c, t, card, "feature_hashing", hash_components, None))
            else:
                report.append((c, t, card, "dropped", 0, f"Dropped high-cardinality ID: {c}"))
        elif t == "TEMPORAL":
            cyc = cyclical_time(frame.select(key, c), c, prefix=f"{c}_")
            joins.append(cyc.drop(c))
            report.append((c, t, card, "cyclical_encoding", 8, None))
        elif t == "BINARY":
            out_cols.append(binary_encoding(df, c).alias(c))
            report.append((c, t, card, "binary_encoding", 1, None))
        elif t == "CATEGORICAL":
            if card > high_cardinality and target is None:
                placed, h = feature_hashing(placed, c, hash_components)
                out_cols += [v.alias(n) for n, v in h.items()]
                report.append((c, t, card, "feature_hashing", hash_components, None))
            elif card > categorical_max:
                enc = target_encoding(frame.select(key, c, target), c, target) if target else \
                    frequency_encoding(frame.select(key, c), c, f"{c}_target_enc")
                joins.append(enc.select(key, f"{c}_target_enc"))
                report.append((c, t, card, "target_encoding", 1, None))
            else:
                d = dummies(df, c)
                out_cols += [v.alias(n) for n, v in d.items()]
                report.append((c, t, card, "one_hot_encoding", len(d), None))
        else:  # CONTINUOUS
            out_cols.append(_c(c).cast("double").alias(c))
            report.append((c, t, card, "continuous", 1, None))
    prepared = placed.select(*out_cols)
    for j in joins:
        prepared = prepared.join(j, key)
    cont = [r[0] for r in report if r[3] == "continuous"]
    if cont:
        prepared = variance_guard(impute_nonfinite(prepared, cont), cont, key, tol)
    final = [F.col(key)] + [F.when(F.abs(_c(c).cast("double")) < float("inf"), _c(c).cast("double")).otherwise(F.lit(0.0)).alias(c)
                            for c in prepared.columns if c != key]
    spark = df.sparkSession
    rep = spark.createDataFrame(report, "feature string, semantic_type string, cardinality long, "
                                        "transformation string, output_dimensions int, warning string")
    out = prepared.select(*final)
    if balance:
        from tabvet.operators.generate import smote
        column, minority = balance
        classed = out.join(df.select(key, F.col(f"`{column}`").alias("_class")), key)
        names = [c for c in out.columns if c != key]
        plain = [f"x{i}" for i in range(len(names))]          # names with dots can't be told from fields
        classed = classed.select(key, *[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain)], "_class")
        grown = smote(df.sparkSession, classed, "_class", minority, key, plain)
        out = grown.select(key, *[F.col(p).alias(c) for p, c in zip(plain, names)], F.col("_class").alias(column), "synthetic")
    return out, rep
