"""Power laws of value frequencies.

The data are the frequencies x of a column's values.  Every distinct frequency
with enough items above it is a candidate x_min with its maximum-likelihood
exponent; the best one has the smallest Kolmogorov-Smirnov distance between the
tail's ECDF and 1 - (x / x_min)^(1 - alpha).

Candidates are not compared with every larger frequency.  The k distinct
frequencies are cut into blocks of sqrt(k): over a block both curves rise, so
their values at its two ends bound the distance inside from both sides.  One
candidate a block is measured in full, which bounds the smallest distance from
above; candidates whose block ends already lie further apart than that are
dropped, and the others are measured only inside blocks whose bound exceeds
their distance at the ends.  Nothing is approximated: dropped candidates and
blocks cannot hold the result.  All columns are fitted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.hashing import hu
from tabvet.operators.ranks import cumulative
from tabvet.session import cut_lineage


def frequency_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, x, m): how many values of a column come x times."""
    def text(c: str) -> Column:
        # -0.0 and 0.0 are one value
        value = F.col(f"`{c}`")
        return (value + F.lit(0.0) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else value).cast("string")

    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), text(c).alias("v")) for c in cols])))
    freqs = long.filter(F.col("v").isNotNull()).groupBy("feature", "v").agg(F.count(F.lit(1)).alias("x"))
    return freqs.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("m"))


def _gap(upto: Column, u: Column, c) -> Column:
    """Distance of the two curves of candidate ``c`` at frequency ``u``."""
    return F.abs(_ecdf(upto, c) - _model(u, c))


def _ecdf(upto: Column, c) -> Column:
    return (upto - c["before"]) / c["n_tail"]


def _model(u: Column, c) -> Column:
    return 1.0 - F.pow(u / c["x_min"], 1.0 - c["alpha"])


def fit_counts(counts: DataFrame, min_tail_fraction: float = 0.05, min_n_tail: int = 100) -> DataFrame:
    """(feature, support_size, x_min, alpha, ks, n_tail) of the best candidate
    of each feature of (feature, x, m); NULLs where none passes."""
    c = cumulative(cut_lineage(counts.withColumn("mlnx", F.col("m") * F.log("x")).withColumn("one", F.lit(1))),
                   ["feature"], "x", ["m", "mlnx", "one"])
    size = F.ceil(F.sqrt(F.col("tot_one")))
    c = cut_lineage(c.withColumn("block", F.floor((F.col("cum_one") - 1) / size))
                    .withColumn("first", (F.col("cum_one") - 1) % size == 0))
    support = c.select("feature", "block", F.col("x").alias("u"), F.col("cum_m").alias("upto"))
    n_tail = F.col("tot_m") - F.col("cum_m") + F.col("m")
    logs = F.col("tot_mlnx") - F.col("cum_mlnx") + F.col("mlnx") - n_tail * F.log("x")
    cand = (c.select("feature", "block", "first", F.col("x").alias("x_min"), n_tail.alias("n_tail"),
                     (F.col("cum_m") - F.col("m")).alias("before"), "tot_m", logs.alias("s"))
            .filter((F.col("n_tail") >= min_n_tail) & (F.col("n_tail") / F.col("tot_m") >= min_tail_fraction) & (F.col("s") > 0))
            .withColumn("alpha", 1.0 + F.col("n_tail") / F.col("s")))
    # one row a column from here to the joins: sqrt(k) structs each
    probes = cand.filter("first").groupBy("feature").agg(
        F.collect_list(F.struct("x_min", "before", "n_tail", "alpha")).alias("probes"))
    seen = support.join(F.broadcast(probes), "feature").select(
        "feature", "u", "upto", F.explode(F.filter("probes", lambda p: p["x_min"] <= F.col("u"))).alias("p"))
    limits = seen.groupBy("feature", "p.x_min").agg(F.max(_gap(F.col("upto"), F.col("u"), F.col("p"))).alias("ks")) \
        .groupBy("feature").agg(F.min("ks").alias("limit"))
    blocks = support.groupBy("feature", "block").agg(
        F.min("u").alias("lo"), F.max("u").alias("hi"), F.min("upto").alias("upto_lo"), F.max("upto").alias("upto_hi")) \
        .groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("block", "lo", "hi", "upto_lo", "upto_hi"))).alias("blocks"))
    me = {n: F.col(n) for n in ("x_min", "before", "n_tail", "alpha")}
    bounds = F.transform(F.filter("blocks", lambda b: b["block"] > F.col("block")), lambda b: F.struct(
        b["block"].alias("block"),
        F.greatest(_gap(b["upto_lo"], b["lo"], me), _gap(b["upto_hi"], b["hi"], me)).alias("least"),
        F.greatest(_ecdf(b["upto_hi"], me) - _model(b["lo"], me), _model(b["hi"], me) - _ecdf(b["upto_lo"], me)).alias("most")))
    rated = (cand.join(F.broadcast(blocks), "feature").join(F.broadcast(limits), "feature", "left")
             .withColumn("b", bounds).withColumn("least", F.coalesce(F.array_max(F.transform("b", lambda x: x["least"])), F.lit(0.0)))
             .filter(F.col("limit").isNull() | (F.col("least") <= F.col("limit"))))
    # a hair's breadth more, as powers are rounded
    look = F.concat(F.array(F.col("block")), F.transform(
        F.filter("b", lambda x: x["most"] + 1e-12 > F.col("least")), lambda x: x["block"]))
    wanted = rated.select("feature", *me, "least", F.explode(look).alias("block"))
    inside = wanted.join(support, ["feature", "block"]).filter("u >= x_min")
    ks = inside.groupBy("feature", "x_min", "alpha", "n_tail").agg(
        F.greatest(F.max(_gap(F.col("upto"), F.col("u"), me)), F.max("least")).alias("ks"))
    best = ks.groupBy("feature").agg(F.min_by(F.struct("x_min", "alpha", "n_tail", "ks"), F.struct("ks", "x_min")).alias("b"))
    sizes = counts.groupBy("feature").agg(F.sum("m").alias("support_size"))
    return sizes.join(F.broadcast(best), "feature", "left").select(
        "feature", "support_size", "b.x_min", "b.alpha", "b.ks", "b.n_tail")


def power_law_fits(df: DataFrame, cols: list[str], min_support: int = 50, min_tail_fraction: float = 0.05,
                   min_n_tail: int = 100, alpha_bounds=(1.2, 5.0), ks_strict: float = 0.2) -> DataFrame:
    """B20 for all columns: the best fit and whether it is a power law by the
    rules (``power_laws`` also asks for the bootstrap p-value of B21); a
    column without values has support 0."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c,) for c in cols], "feature string")
    fit = F.broadcast(names).join(fit_counts(frequency_counts(df, cols), min_tail_fraction, min_n_tail), "feature", "left")
    out = fit.withColumn("tail_fraction", F.col("n_tail") / F.col("support_size")).select(
        "feature", "support_size", "x_min", "alpha", "ks", "n_tail", "tail_fraction")
    ok = ((F.col("support_size") >= min_support) & F.col("x_min").isNotNull()
          & (F.col("alpha") >= alpha_bounds[0]) & (F.col("alpha") <= alpha_bounds[1]) & (F.col("ks") <= ks_strict))
    return out.withColumn("is_power_law", F.coalesce(ok, F.lit(False)))


def power_law_fit(df: DataFrame, col: str, **rules) -> DataFrame:
    """B20 of one column."""
    return power_law_fits(df, [col], **rules)


def power_law_bootstrap(fit: DataFrame, runs: int = 200, seed: int = 42) -> DataFrame:
    """``runs`` synthetic tails of n_tail draws x = x_min U^{1/(1-α)},
    rounded and floored at x_min (U a hash uniform of (seed, run, i)); KS
    of each against the fitted model; p = share of runs with KS >= the
    observed KS.  The runs x n_tail draw rows come from a distributed range;
    the one-row fit is known to the driver."""
    one = fit.filter(F.col("x_min").isNotNull()).select("x_min", "alpha", "n_tail", "ks").first()
    n_tail = int(one["n_tail"]) if one else 0
    draws = fit.sparkSession.range(runs * n_tail).select(
        F.lit(one["x_min"] if one else 1).alias("x_min"), F.lit(one["alpha"] if one else 2.0).alias("alpha"),
        F.lit(n_tail).cast("long").alias("n_tail"), F.lit(one["ks"] if one else 0.0).alias("ks"),
        F.expr(f"CAST(id div {max(n_tail, 1)} + 1 AS INT)").alias("run"), (F.col("id") % max(n_tail, 1) + 1).alias("i"))
    u = F.greatest(hu(seed, "run", "i"), F.lit(1e-300))
    x = F.greatest(F.round(F.col("x_min") * F.pow(u, 1.0 / (1.0 - F.col("alpha")))), F.col("x_min").cast("double"))
    sims = draws.select("run", "x_min", "alpha", "n_tail", "ks", x.alias("x"))
    vc = sims.groupBy("run", "x_min", "alpha", "n_tail", "ks", "x").agg(F.count(F.lit(1)).alias("m"))
    c = cumulative(vc, ["run"], "x", "m")
    model = 1.0 - F.pow(F.col("x") / F.col("x_min"), 1.0 - F.col("alpha"))
    per = c.groupBy("run", "ks").agg(F.max(F.abs(F.col("cum_m") / F.col("n_tail") - model)).alias("ks_sim"))
    return per.agg(F.avg((F.col("ks_sim") >= F.col("ks")).cast("double")).alias("p_value"),
                   F.count(F.lit(1)).alias("runs"))


def power_laws(df: DataFrame, cols: list[str], p_min: float = 0.05, runs: int = 200, **rules) -> DataFrame:
    """B20 with B21: one fit of all columns, then the bootstrap p-value of
    those that pass the rules (at most one job each); a power law also needs
    p >= ``p_min``."""
    fits = cut_lineage(power_law_fits(df, cols, **rules))
    passing = [r["feature"] for r in fits.filter("is_power_law").select("feature").collect()]      # column names
    out = fits.withColumn("p_value", F.lit(None).cast("double"))
    if passing:
        parts = [power_law_bootstrap(fits.filter(F.col("feature") == c), runs).select(F.lit(c).alias("feature"), "p_value")
                 for c in passing]
        p = parts[0]
        for more in parts[1:]:
            p = p.unionByName(more)
        out = fits.join(F.broadcast(cut_lineage(p)), "feature", "left")
    return out.withColumn("is_power_law", F.col("is_power_law") & F.coalesce(F.col("p_value") >= p_min, F.lit(False)))


def power_law(df: DataFrame, col: str, p_min: float = 0.05, runs: int = 200, **rules) -> DataFrame:
    """B20 with B21 of one column."""
    return power_laws(df, [col], p_min, runs, **rules)
