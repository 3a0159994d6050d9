"""Real-versus-synthetic fidelity metrics.

Both tables are tagged and handled in one long form (feature, side, v),
so every metric family is one grouped job over all columns.  Ordered
statistics (KS, Wasserstein, ranks) use the prefix-sum kernel on
pre-aggregated (feature, value) counts; nothing is collected except one
row per feature or per matrix cell.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.operators import mixtures
from tabvet.operators.profile import kolmogorov_p, to_long
from tabvet.operators.ranks import _bucket_expr, cumulative
from tabvet.operators.relations import chi2_sf, correlation_matrix
from tabvet.session import cut_lineage
from tabvet.sources.io import scratch_path

REAL, SYNTH = 0, 1


def tagged_long(real: DataFrame, synth: DataFrame, cols: list[str], kind: str = "double") -> DataFrame:
    """(feature, side, v) with side 0 = real, 1 = synthetic; NULLs dropped."""
    a = to_long(real.select(*cols), cols, kind).withColumn("side", F.lit(REAL))
    b = to_long(synth.select(*cols), cols, kind).withColumn("side", F.lit(SYNTH))
    return a.unionByName(b).filter(F.col("v").isNotNull())


def side_counts(long: DataFrame) -> DataFrame:
    """(feature, v, c_real, c_synth): both sides' counts per distinct value."""
    return long.groupBy("feature", "v").agg(
        F.count_if(F.col("side") == REAL).alias("c_real"),
        F.count_if(F.col("side") == SYNTH).alias("c_synth"))


# ---------------------------------------------------------------------------
# Categorical distributions
# ---------------------------------------------------------------------------

def aligned_distributions(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, v, p_real, p_synth) on the union of categories, a
    missing side is 0 (the full outer join is the union of count tables)."""
    sc = side_counts(tagged_long(real, synth, cols, "string"))
    tot = sc.groupBy("feature").agg(F.sum("c_real").alias("n_real"), F.sum("c_synth").alias("n_synth"))
    j = sc.join(F.broadcast(tot), "feature")
    return j.select("feature", "v", (F.col("c_real") / F.col("n_real")).alias("p_real"),
                    (F.col("c_synth") / F.col("n_synth")).alias("p_synth"))


def _js_terms(p: Column, q: Column) -> Column:
    m = (p + q) / 2.0
    tp = F.when(p > 0, p * F.log(p / m)).otherwise(F.lit(0.0))
    tq = F.when(q > 0, q * F.log(q / m)).otherwise(F.lit(0.0))
    return 0.5 * tp + 0.5 * tq


def js_tv(aligned: DataFrame, p: str = "p_real", q: str = "p_synth") -> DataFrame:
    """Jensen-Shannon distance (natural log, sqrt) and total
    variation per feature; inputs are renormalised to sum 1."""
    tot = aligned.groupBy("feature").agg(F.sum(p).alias("_sp"), F.sum(q).alias("_sq"))
    j = aligned.join(F.broadcast(tot), "feature")
    pn, qn = F.col(p) / F.col("_sp"), F.col(q) / F.col("_sq")
    return j.groupBy("feature").agg(F.sqrt(F.greatest(F.sum(_js_terms(pn, qn)), F.lit(0.0))).alias("js_distance"),
                                    (0.5 * F.sum(F.abs(pn - qn))).alias("tv_distance"))


def category_coverage(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """I4: |distinct(real) ∩ distinct(synth)| / |distinct(real)|."""
    sc = side_counts(tagged_long(real, synth, cols, "string"))
    return sc.groupBy("feature").agg(
        (F.count_if((F.col("c_real") > 0) & (F.col("c_synth") > 0))
         / F.greatest(F.count_if(F.col("c_real") > 0), F.lit(1))).alias("coverage"))


# ---------------------------------------------------------------------------
# Numeric distributions
# ---------------------------------------------------------------------------

def _ecdfs(real: DataFrame, synth: DataFrame, cols: list[str], with_next: bool = False) -> DataFrame:
    sc = side_counts(tagged_long(real, synth, cols))
    c = cumulative(sc, ["feature"], "v", ["c_real", "c_synth"], with_next=with_next)
    return c.withColumn("F", F.col("cum_c_real") / F.col("tot_c_real")) \
        .withColumn("G", F.col("cum_c_synth") / F.col("tot_c_synth"))


def ks_two_sample(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """D = sup |F_real - F_synth| over the pooled values; p from the
    asymptotic Kolmogorov distribution at sqrt(n m / (n + m)) D."""
    c = _ecdfs(real, synth, cols)
    d = c.groupBy("feature").agg(F.max(F.abs(F.col("F") - F.col("G"))).alias("ks_statistic"),
                                 F.first("tot_c_real").alias("n_real"), F.first("tot_c_synth").alias("n_synth"))
    en = F.col("n_real") * F.col("n_synth") / (F.col("n_real") + F.col("n_synth"))
    return d.select("feature", "ks_statistic", kolmogorov_p(F.sqrt(en) * F.col("ks_statistic")).alias("ks_p_value"),
                    "n_real", "n_synth")


def ks_summary(ks: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Share of features with p > alpha, mean p."""
    return ks.agg((F.count_if(F.col("ks_p_value") > alpha) / F.count(F.lit(1))).alias("pass_rate"),
                  F.avg("ks_p_value").alias("average_p_value"), F.count(F.lit(1)).alias("n_features"))


def wasserstein(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """W1 = Σ |F - G| (x_{i+1} - x_i) over pooled sorted values; also the
    pooled range for I8."""
    c = _ecdfs(real, synth, cols, with_next=True)
    term = F.abs(F.col("F") - F.col("G")) * (F.col("next_v") - F.col("v"))
    return c.groupBy("feature").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("wasserstein"),
                                    (F.max("v") - F.min("v")).alias("range"))


def wasserstein_normalized(w: DataFrame) -> DataFrame:
    """I8: W / pooled range per feature, then mean / median / std (pop) /
    min / max over features."""
    wn = w.select("feature", F.when(F.col("range") > 0, F.col("wasserstein") / F.col("range"))
                  .otherwise(F.col("wasserstein")).alias("d"))
    return wn.agg(F.avg("d").alias("mean_distance"), F.median("d").alias("median_distance"),
                  F.stddev_pop("d").alias("std_distance"), F.min("d").alias("min_distance"),
                  F.max("d").alias("max_distance"))


def moment_stats(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, side, mean, std ddof 1, std ddof 0) for both tables in one job."""
    long = tagged_long(real, synth, cols)
    return long.groupBy("feature", "side").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                               F.stddev_pop("v").alias("std_pop"))


def _sides(m: DataFrame) -> DataFrame:
    r = m.filter(F.col("side") == REAL).select("feature", F.col("mean").alias("mr"), F.col("std").alias("sr"),
                                               F.col("std_pop").alias("spr"))
    s = m.filter(F.col("side") == SYNTH).select("feature", F.col("mean").alias("ms"), F.col("std").alias("ss"),
                                                F.col("std_pop").alias("sps"))
    return r.join(s, "feature")


def moment_gap(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """‖μ_r - μ_s‖₂ + ‖σ_r - σ_s‖₂ over the column vector (ddof 1)."""
    j = _sides(moment_stats(real, synth, cols))
    return j.agg((F.sqrt(F.sum((F.col("mr") - F.col("ms")) ** 2))
                  + F.sqrt(F.sum((F.col("sr") - F.col("ss")) ** 2))).alias("moment_gap"))


def relative_moments(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """|Δmean| / (|mean_r| + 1e-8), |Δstd| / (std_r + 1e-8), ddof 1."""
    j = _sides(moment_stats(real, synth, cols))
    return j.select("feature", (F.abs(F.col("mr") - F.col("ms")) / (F.abs("mr") + 1e-8)).alias("mean_difference"),
                    (F.abs(F.col("sr") - F.col("ss")) / (F.col("sr") + 1e-8)).alias("std_difference"),
                    F.col("mr").alias("real_mean"), F.col("ms").alias("synth_mean"))


def batch_consistency(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """(Δmean)² + (Δstd_pop)² per continuous column and their mean."""
    j = _sides(moment_stats(real, synth, cols))
    t = j.select("feature", ((F.col("mr") - F.col("ms")) ** 2 + (F.col("spr") - F.col("sps")) ** 2).alias("loss"))
    return t


# ---------------------------------------------------------------------------
# Histogram / KDE / chi-square
# ---------------------------------------------------------------------------

def histogram_js(real: DataFrame, synth: DataFrame, cols: list[str], n_bins: int = 49,
                 smoothing: float = 0.0) -> DataFrame:
    """I11 (49 bins, pass JS < 0.1) / I12 (100 bins, +1e-10 smoothing):
    equal-width bins over the pooled [min, max] (last bin closed; a zero
    range is widened to 1), JS distance of the normalised histograms.
    Every bin index 0..n-1 is present (empty bins count 0)."""
    long = tagged_long(real, synth, cols)
    st = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    st = st.withColumn("hi", F.when(F.col("hi") - F.col("lo") < 1e-10, F.col("lo") + 1).otherwise(F.col("hi")))
    width = (F.col("hi") - F.col("lo")) / n_bins
    b = long.join(F.broadcast(st), "feature").withColumn(
        "bin", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(n_bins - 1)).cast("int"))
    counts = b.groupBy("feature", "bin").agg(F.count_if(F.col("side") == REAL).alias("cr"),
                                             F.count_if(F.col("side") == SYNTH).alias("cs"))
    ns = long.groupBy("feature").agg(F.count_if(F.col("side") == REAL).alias("nr"),
                                     F.count_if(F.col("side") == SYNTH).alias("ns"))
    # dense bins: one row per (feature, bin) from a fixed-size sequence
    grid = st.select("feature", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    dense = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["cr", "cs"]).join(F.broadcast(ns), "feature")
    w = (F.col("hi") - F.col("lo")) / n_bins
    # densities (count / (n width)); the smoothing is added to densities
    h = dense.select("feature", (F.col("cr") / (F.col("nr") * w) + F.lit(smoothing)).alias("p_real"),
                     (F.col("cs") / (F.col("ns") * w) + F.lit(smoothing)).alias("p_synth"), F.lit("x").alias("v"))
    out = js_tv(h)
    return out.select("feature", F.col("js_distance").alias("divergence"),
                      (1.0 - F.col("js_distance")).alias("similarity"), (F.col("js_distance") < 0.1).alias("passed"))


def kde_js(real: DataFrame, synth: DataFrame, cols: list[str], grid: int = 100, bins: int = 2048,
           bandwidth: float | None = None) -> DataFrame:
    """Gaussian-KDE densities of both sides on a ``grid``-point
    linspace over the pooled range (Scott's factor n^-1/5 times the side's
    std), normalised, JS distance.  Binned: each side is histogrammed into
    ``bins`` bins first, so the kernel sum is bins x grid per feature."""
    long = tagged_long(real, synth, cols)
    st = long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    ss = long.groupBy("feature", "side").agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"))
    width = (F.col("hi") - F.col("lo")) / bins
    hb = (long.join(F.broadcast(st), "feature")
          .withColumn("b", F.least(F.floor((F.col("v") - F.col("lo")) / width), F.lit(bins - 1)).cast("int"))
          .groupBy("feature", "side", "b").agg(F.count(F.lit(1)).alias("c")))
    hb = hb.join(F.broadcast(st), "feature").join(F.broadcast(ss), ["feature", "side"])
    factor = F.lit(bandwidth) if bandwidth else F.pow(F.col("n").cast("double"), -0.2)
    h = F.col("sd") * factor
    xc = F.col("lo") + (F.col("b") + 0.5) * width
    g = hb.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    xg = F.col("lo") + F.col("gi") * (F.col("hi") - F.col("lo")) / (grid - 1)
    dens = g.groupBy("feature", "side", "gi").agg(
        F.sum(F.col("c") * F.exp(-0.5 * F.pow((xg - xc) / h, 2))).alias("d"))
    wide = dens.groupBy("feature", "gi").agg(F.sum(F.when(F.col("side") == REAL, F.col("d"))).alias("p_real"),
                                             F.sum(F.when(F.col("side") == SYNTH, F.col("d"))).alias("p_synth"))
    wide = wide.fillna(0.0, ["p_real", "p_synth"]).withColumn("v", F.col("gi").cast("string"))
    return js_tv(wide).select("feature", F.col("js_distance").alias("divergence"))


def chi_square_proportions(real: DataFrame, synth: DataFrame, cols: list[str], alpha: float = 0.05) -> DataFrame:
    """χ² of synthetic proportions against real proportions
    Σ (q - p)² / p (sample-size free, as the reference computes it; NULL
    when a synthetic-only category makes p = 0), the count-based χ²
    Σ (O - E)² / E with E = p · n_synth, and both p-values (k - 1 dof)."""
    al = aligned_distributions(real, synth, cols)
    n = side_counts(tagged_long(real, synth, cols, "string")).groupBy("feature").agg(F.sum("c_synth").alias("ns"))
    j = al.join(F.broadcast(n), "feature")
    stat = j.groupBy("feature").agg(
        F.sum(F.try_divide((F.col("p_synth") - F.col("p_real")) ** 2, F.col("p_real"))).alias("statistic"),
        F.sum(F.try_divide((F.col("p_synth") * F.col("ns") - F.col("p_real") * F.col("ns")) ** 2,
                           F.col("p_real") * F.col("ns"))).alias("count_statistic"),
        F.max(F.when(F.col("p_real") == 0, 1).otherwise(0)).alias("_zero"),
        F.count(F.lit(1)).alias("k"))
    stat = stat.withColumn("statistic", F.when(F.col("_zero") == 1, F.lit(None)).otherwise(F.col("statistic"))) \
        .withColumn("count_statistic", F.when(F.col("_zero") == 1, F.lit(None)).otherwise(F.col("count_statistic")))
    dof = (F.col("k") - 1).cast("double")
    out = stat.withColumn("pvalue", chi2_sf(F.col("statistic"), dof)) \
        .withColumn("count_pvalue", chi2_sf(F.col("count_statistic"), dof))
    return out.select("feature", "statistic", "pvalue", (F.col("pvalue") > alpha).alias("passed"),
                      "count_statistic", "count_pvalue")


# ---------------------------------------------------------------------------
# Correlation structure
# ---------------------------------------------------------------------------

def paired_matrices(real: DataFrame, synth: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """(col1, col2, r_real, r_synth) over the full k x k matrices."""
    a = correlation_matrix(real, cols, method).withColumnRenamed("corr", "r_real")
    b = correlation_matrix(synth, cols, method).withColumnRenamed("corr", "r_synth")
    return a.join(b, ["col1", "col2"])


def matrix_similarity(pm: DataFrame) -> DataFrame:
    """I18 / I19 / I20 over the flattened matrices (k² cells, a tiny table):
    Pearson and Spearman of the cell vectors, mean |Δ|, RMS Δ, rank
    preservation (Spearman of ordinal ranks), Frobenius similarity
    1 - ‖Δ‖_F / sqrt(2 k²)."""
    v = pm.filter(F.col("r_real").isNotNull() & F.col("r_synth").isNotNull() & ~F.isnan("r_real")
                  & ~F.isnan("r_synth"))
    # average and ordinal ranks over k² cells: one small window each
    wa, wb = Window.orderBy("r_real"), Window.orderBy("r_synth")
    avg_rank = lambda c, w: (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy(c)) - 1) / 2.0)  # noqa
    v = v.select("*", avg_rank("r_real", wa).alias("ar"), avg_rank("r_synth", wb).alias("as"),
                 F.row_number().over(Window.orderBy("r_real", "col1", "col2")).alias("or_"),
                 F.row_number().over(Window.orderBy("r_synth", "col1", "col2")).alias("os_"))
    d = F.col("r_real") - F.col("r_synth")
    return v.agg(F.corr("r_real", "r_synth").alias("pearson_correlation"),
                 F.corr("ar", "as").alias("spearman_correlation"),
                 F.avg(F.abs(d)).alias("mean_absolute_difference"),
                 F.sqrt(F.avg(d * d)).alias("rms_difference"),
                 F.max(F.abs(d)).alias("max_absolute_difference"),
                 F.corr("or_", "os_").alias("rank_preservation"),
                 (1.0 - F.sqrt(F.sum(d * d)) / F.sqrt(2.0 * F.count(F.lit(1)))).alias("frobenius_similarity"))


#: Weighted value pairs that one task sorts at most, as long as there are at most KENDALL_RANGES of them a column.
KENDALL_CELLS = 20_000
KENDALL_RANGES = 2048


def _signed_pairs(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Σ c_i c_j sign(x_j - x_i) sign(y_j - y_i) over all pairs: bit by bit of
    the ranks of x, the upper half of each block is looked up in its lower
    half sorted by y."""
    xr, yr = np.unique(x, return_inverse=True)[1], np.unique(y, return_inverse=True)[1]
    span, total = int(yr.max()) + 1, 0.0
    for bit in range(int(xr.max()).bit_length()):
        block, upper = xr >> (bit + 1), ((xr >> bit) & 1).astype(bool)
        low = block[~upper] * span + yr[~upper]
        order = np.argsort(low, kind="stable")
        low, upto = low[order], np.concatenate([[0.0], np.cumsum(c[~upper][order])])
        first = block[upper] * span
        at = [upto[np.searchsorted(low, k, side)] for k, side in (
            (first, "left"), (first + yr[upper], "left"), (first + yr[upper], "right"), (first + span, "left"))]
        total += float((c[upper] * ((at[1] - at[0]) - (at[3] - at[2]))).sum())
    return total


def _signed_group(pdf: pd.DataFrame) -> pd.DataFrame:
    s = _signed_pairs(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["c"].to_numpy(float))
    return pd.DataFrame({"pair": pdf["pair"].iloc[:1].to_numpy(), "s": [s]})


def kendall_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """τ-b of every two columns (col1, col2, kendall_tau_b), rows with a
    NULL in either left out.  Distinct (x, y) pairs with their counts are cut
    into quantile ranges of x and of y.  Concordant minus discordant pairs are
    those within one x range, those within one y range but in different x
    ranges, and those in different ranges of both, which need the ranges'
    totals only."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    each = F.array(*[F.struct(F.lit(k).alias("pair"), F.col(f"`{a}`").cast("double").alias("x"),
                              F.col(f"`{b}`").cast("double").alias("y")) for k, (a, b) in enumerate(pairs)])
    cells = cut_lineage(df.select(F.explode(each).alias("p")).select("p.*").dropna()
                        .groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("c")))
    ranges = max(1, min(KENDALL_RANGES, -(-cells.count() // (KENDALL_CELLS * len(pairs)))))
    probs = [i / ranges for i in range(1, ranges)] or [0.5]
    bounds = cells.groupBy("pair").agg(*[F.array_distinct(F.percentile_approx(v, probs, 10_000)).alias(f"_{v}")
                                         for v in "xy"])
    cut = cells.join(F.broadcast(bounds), "pair").select(
        "pair", "x", "y", "c", *[(_bucket_expr(f"_{v}", v) if ranges > 1 else F.lit(0)).alias(f"b{v}") for v in "xy"])
    schema = "pair int, s double"
    signed = cut.groupBy("pair", "bx").applyInPandas(lambda p: _signed_group(p), schema)
    if ranges > 1:
        across = cut.groupBy("pair", "bx", "by", "y").agg(F.sum("c").alias("c"))
        same_y = across.select("pair", "by", F.col("bx").alias("x"), "y", "c").groupBy("pair", "by").applyInPandas(
            lambda p: _signed_group(p), schema)
        totals = across.groupBy("pair", F.col("bx").alias("x"), F.col("by").alias("y")).agg(F.sum("c").alias("c"))
        signed = signed.unionByName(same_y).unionByName(totals.groupBy("pair").applyInPandas(
            lambda p: _signed_group(p), schema))
    tie = F.sum(F.col("c") * (F.col("c") - 1) / 2)
    tx = cells.groupBy("pair", "x").agg(F.sum("c").alias("c")).groupBy("pair").agg(tie.alias("n1"))
    ty = cells.groupBy("pair", "y").agg(F.sum("c").alias("c")).groupBy("pair").agg(tie.alias("n2"))
    n0 = F.col("n") * (F.col("n") - 1) / 2
    names = df.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "pair int, col1 string, col2 string")
    return (names.join(signed.groupBy("pair").agg(F.sum("s").alias("s")), "pair")
            .join(cells.groupBy("pair").agg(F.sum("c").alias("n")), "pair").join(tx, "pair").join(ty, "pair")
            .select("col1", "col2", (F.col("s") / F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2")))).alias("kendall_tau_b")))


def kendall_tau_b(df: DataFrame, a: str, b: str) -> DataFrame:
    """I17 for one pair of columns."""
    return kendall_matrix(df, [a, b])


# ---------------------------------------------------------------------------
# Modes and collapse
# ---------------------------------------------------------------------------

def _features(df: DataFrame, cols: list[str]):
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(
        df.select(*[F.col(c).cast("double").alias(c) for c in cols]))


def kmeans_coverage(real: DataFrame, synth: DataFrame, cols: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """K-means (k=5, seed 42) fitted on real; share of real clusters
    that receive at least one synthetic row."""
    from pyspark.ml.clustering import KMeans
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="m").fit(_features(real, cols))
    rl = model.transform(_features(real, cols)).select("m").distinct()
    sl = model.transform(_features(synth, cols)).select("m").distinct()
    hit = rl.join(sl, "m", "left_semi")
    return rl.agg(F.count(F.lit(1)).alias("real_modes")).withColumn("_k", F.lit(1)).join(
        hit.agg(F.count(F.lit(1)).alias("covered")).withColumn("_k", F.lit(1)), "_k").select(
        "real_modes", "covered", (F.col("covered") / F.col("real_modes")).alias("mode_coverage"))


def gmm_coverage(real: DataFrame, synth: DataFrame, cols: list[str], k_range=(2, 10), seed: int = 42,
                 min_unique: int = 10) -> DataFrame:
    """Gaussian mixture on real features with more than ``min_unique``
    values, k chosen by BIC over ``k_range`` (all sizes fitted side by side);
    coverage = share of real modes hit by synthetic rows; per-mode shares on
    both sides."""
    use = mixtures.varied(real, cols, min_unique) or cols
    fr, fs = (df.select(*[F.col(c).cast("double").alias(c) for c in use]).dropna() for df in (real, synth))
    n, distinct = fr.agg(F.count(F.lit(1)), F.approx_count_distinct(F.struct(*use))).first()
    d = len(use)
    sizes = list(range(k_range[0], k_range[1] + 1))
    begun = mixtures.starts(fr, sizes, seed, n)
    pts = mixtures.packed(mixtures.points(fr, use, n), use, distinct).cache()
    best = None
    for k, m in zip(sizes, mixtures.fit(pts, use, begun)):
        params = k * (d + d * (d + 1) / 2) + (k - 1)
        bic = -2 * m.log_likelihood + params * math.log(n)
        if best is None or bic < best[0]:
            best = (bic, k, m)
    _, k, model = best
    rl = cut_lineage(mixtures.mode_counts(pts, use, model, "real_n"))
    pts.unpersist()
    sl = mixtures.mode_counts(fs.withColumn("n", F.lit(1)), use, model, "synth_n")
    j = rl.join(sl, "m", "left").fillna(0, ["synth_n"])
    w = Window.partitionBy()
    return j.select(F.lit(k).alias("k"), "m", (F.col("real_n") / F.sum("real_n").over(w)).alias("real_share"),
                    (F.col("synth_n") / F.sum("synth_n").over(w)).alias("synth_share"),
                    (F.count_if(F.col("synth_n") > 0).over(w) / F.count(F.lit(1)).over(w)).alias("coverage"))


def interpret_coverage(c: Column) -> Column:
    """.9 / .7 / .5 bands."""
    return (F.when(c >= 0.9, "Excellent mode coverage").when(c >= 0.7, "Good mode coverage")
            .when(c >= 0.5, "Acceptable mode coverage").otherwise("Poor mode coverage - possible mode collapse"))


def mean_cosine_similarity(df: DataFrame, cols: list[str]) -> DataFrame:
    """Mean pairwise cosine similarity over all distinct pairs in
    closed form: (‖Σ x̂‖² - Σ ‖x̂‖²) / (n (n - 1)), x̂ = x / ‖x‖ (zero rows
    stay zero).  One aggregation, no pair enumeration."""
    x = [F.col(c).cast("double") for c in cols]
    norm = F.sqrt(sum(v * v for v in x))
    unit = [F.when(norm > 0, v / norm).otherwise(F.lit(0.0)) for v in x]
    sq = sum(u * u for u in unit)
    aggs = [F.sum(u).alias(f"s{i}") for i, u in enumerate(unit)] + [F.sum(sq).alias("ss"), F.count(F.lit(1)).alias("n")]
    a = df.select(*[F.col(c) for c in cols]).dropna().agg(*aggs)
    tot = sum(F.col(f"s{i}") ** 2 for i in range(len(cols)))
    return a.select(F.when(F.col("n") > 1, (tot - F.col("ss")) / (F.col("n") * (F.col("n") - 1)))
                    .otherwise(F.lit(0.0)).alias("similarity_score"))


def joint_entropy(df: DataFrame, cols: list[str], n_bins: int = 20) -> DataFrame:
    """Entropy of the joint equal-width histogram (n_bins per
    dimension, last bin closed), normalised by ln(n_bins^d); only occupied
    cells are materialised (grouped count)."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    mm = d.agg(*[F.min(c).alias(f"lo_{c}") for c in cols], *[F.max(c).alias(f"hi_{c}") for c in cols])
    j = d.withColumn("_k", F.lit(1)).join(F.broadcast(mm.withColumn("_k", F.lit(1))), "_k")
    bins = []
    for c in cols:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        w = F.when(hi > lo, (hi - lo) / n_bins).otherwise(F.lit(1.0))
        bins.append(F.least(F.floor((F.col(c) - lo) / w), F.lit(n_bins - 1)).cast("int").alias(f"b_{c}"))
    cells = j.select(*bins).groupBy(*[f"b_{c}" for c in cols]).agg(F.count(F.lit(1)).alias("c"))
    tot = cells.agg(F.sum("c").alias("n"))
    p = cells.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k") \
        .select((F.col("c") / F.col("n")).alias("p"))
    max_e = len(cols) * math.log(n_bins)
    return p.agg((-F.sum(F.col("p") * F.log(F.col("p") + 1e-10)) / F.lit(max_e)).alias("normalized_entropy"))


def collapse_verdict(diversity_col: Column, similarity_col: Column, coverage_col: Column,
                     div_thr: float = 0.8, sim_thr: float = 0.9, cov_thr: float = 0.7) -> Column:
    """Any two of (diversity < .8, similarity > .9, coverage < .7), or
    diversity < .3."""
    n = ((diversity_col < div_thr).cast("int") + (similarity_col > sim_thr).cast("int")
         + (coverage_col < cov_thr).cast("int"))
    return (n >= 2) | (diversity_col < 0.3)


# ---------------------------------------------------------------------------
# Original versus transformed (row-aligned)
# ---------------------------------------------------------------------------

def binned_mi(df: DataFrame, x: str, y: str, bins: int = 20) -> DataFrame:
    """MI of the 20 x 20 equal-width joint histogram (nats, +1e-12 in
    the denominator as in the reference)."""
    d = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    mm = d.agg(F.min("x").alias("lx"), F.max("x").alias("hx"), F.min("y").alias("ly"), F.max("y").alias("hy"))
    j = d.withColumn("_k", F.lit(1)).join(F.broadcast(mm.withColumn("_k", F.lit(1))), "_k")

    def b(v, lo, hi):
        w = F.when(F.col(hi) > F.col(lo), (F.col(hi) - F.col(lo)) / bins).otherwise(F.lit(1.0))
        return F.least(F.floor((F.col(v) - F.col(lo)) / w), F.lit(bins - 1)).cast("int")

    cells = j.select(b("x", "lx", "hx").alias("bx"), b("y", "ly", "hy").alias("by")) \
        .groupBy("bx", "by").agg(F.count(F.lit(1)).alias("c"))
    n = cells.agg(F.sum("c").alias("n"))
    px = cells.groupBy("bx").agg(F.sum("c").alias("cx"))
    py = cells.groupBy("by").agg(F.sum("c").alias("cy"))
    t = cells.join(px, "bx").join(py, "by").withColumn("_k", F.lit(1)) \
        .join(F.broadcast(n.withColumn("_k", F.lit(1))), "_k")
    pxy, pxx, pyy = F.col("c") / F.col("n"), F.col("cx") / F.col("n"), F.col("cy") / F.col("n")
    return t.agg(F.sum(pxy * F.log(pxy / (pxx * pyy + 1e-12))).alias("mutual_information"))


def column_preservation(df: DataFrame, orig: str, trans: str) -> DataFrame:
    """Spearman of average ranks, relative mean / std (ddof 0,
    +1e-12), KS two-sample, binned MI for an original/transformed column
    pair of one table."""
    from tabvet.operators.relations import attach_ranks
    d = df.select(F.col(orig).cast("double").alias("o"), F.col(trans).cast("double").alias("t")).dropna()
    r = attach_ranks(d, ["o", "t"])
    sp = r.agg(F.corr("_r_o", "_r_t").alias("spearman_correlation"))
    mo = d.agg(((F.abs(F.avg("o") - F.avg("t"))) / (F.abs(F.avg("o")) + 1e-12)).alias("mean_preservation"),
               ((F.abs(F.stddev_pop("o") - F.stddev_pop("t"))) / (F.stddev_pop("o") + 1e-12)).alias("std_preservation"))
    ks = ks_two_sample(d.select(F.col("o").alias("v")), d.select(F.col("t").alias("v")), ["v"]) \
        .select("ks_statistic", "ks_p_value")
    mi = binned_mi(d, "o", "t")
    k = F.lit(1)
    out = sp.withColumn("_k", k)
    for part in (mo, ks, mi):
        out = out.join(part.withColumn("_k", k), "_k")
    return out.drop("_k")


def transformation_score(sim: Column | None, mean_pres: Column | None, std_pres: Column | None,
                         mi: Column | None, hierarchy: Column | None) -> Column:
    """Mean of the available components, each in [0, 1]: clipped
    correlation similarity, 1 - mean / std preservation, 1 - exp(-MI),
    hierarchy (1 preserved / 0.5 not).  NULL components are skipped."""
    parts = []
    if sim is not None:
        parts.append(F.least(F.greatest(sim, F.lit(0.0)), F.lit(1.0)))
    if mean_pres is not None:
        parts.append(F.greatest(F.lit(0.0), 1.0 - mean_pres))
    if std_pres is not None:
        parts.append(F.greatest(F.lit(0.0), 1.0 - std_pres))
    if mi is not None:
        parts.append(1.0 - F.exp(-mi))
    if hierarchy is not None:
        parts.append(F.when(hierarchy, F.lit(1.0)).otherwise(F.lit(0.5)))
    num = sum(F.coalesce(p, F.lit(0.0)) for p in parts)
    den = sum(F.when(p.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)) for p in parts)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def hierarchy_preservation(original: DataFrame, transformed: DataFrame, group: str, value: str,
                           key: str) -> DataFrame:
    """I32: group means of ``value`` before and after, Spearman of the two
    mean vectors (the reference leaves this a stub)."""
    a = original.groupBy(group).agg(F.avg(value).alias("m_orig"))
    b = transformed.groupBy(group).agg(F.avg(value).alias("m_trans"))
    j = a.join(b, group)
    from tabvet.operators.relations import attach_ranks
    r = attach_ranks(j, ["m_orig", "m_trans"])
    return r.agg(F.corr("_r_m_orig", "_r_m_trans").alias("group_mean_spearman"),
                 F.count(F.lit(1)).alias("n_groups")) \
        .withColumn("preserved", F.col("group_mean_spearman") > 0.9)


# ---------------------------------------------------------------------------
# Scores, verdicts, pluggable audit
# ---------------------------------------------------------------------------

def quality_score_a(js: Column, corr: Column, privacy: Column) -> Column:
    """(.4 max(0, 1 - 10 JS) + .3 (corr + 1)/2 + .3 privacy) / Σw over
    available parts."""
    parts = [(0.4, F.greatest(F.lit(0.0), 1.0 - 10.0 * js)), (0.3, (corr + 1.0) / 2.0), (0.3, privacy)]
    num = sum(F.coalesce(v * w, F.lit(0.0)) for w, v in parts)
    den = sum(F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, v in parts)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def quality_score_c(w: Column, js: Column, corr: Column, coverage: Column) -> Column:
    """.3/(1+W) + .25/(1+JS) + .25 corr + .2 coverage, re-normalised
    to the metrics present."""
    parts = [(0.3, 1.0 / (1.0 + w)), (0.25, 1.0 / (1.0 + js)), (0.25, corr), (0.2, coverage)]
    num = sum(F.coalesce(v * wt, F.lit(0.0)) for wt, v in parts)
    den = sum(F.when(v.isNotNull(), F.lit(wt)).otherwise(F.lit(0.0)) for wt, v in parts)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def verdict(score: Column) -> Column:
    """.9 / .7 / .5 bands."""
    return (F.when(score >= 0.9, "EXCELLENT").when(score >= 0.7, "GOOD").when(score >= 0.5, "FAIR")
            .otherwise("POOR"))


# Pluggable metric registry: name -> f(real, synth, cols) -> DataFrame(feature?, metric, value)
METRICS: dict = {}


def register_metric(name: str):
    def deco(fn):
        METRICS[name] = fn
        return fn
    return deco


@register_metric("ks")
def _m_ks(real, synth, num, cat):
    return ks_two_sample(real, synth, num).select("feature", F.lit("ks_statistic").alias("metric"),
                                                  F.col("ks_statistic").alias("value"))


@register_metric("wasserstein")
def _m_w(real, synth, num, cat):
    return wasserstein(real, synth, num).select("feature", F.lit("wasserstein").alias("metric"),
                                                F.col("wasserstein").alias("value"))


@register_metric("js_histogram")
def _m_js(real, synth, num, cat):
    return histogram_js(real, synth, num).select("feature", F.lit("js_divergence").alias("metric"),
                                                 F.col("divergence").alias("value"))


@register_metric("js_categorical")
def _m_jsc(real, synth, num, cat):
    return js_tv(aligned_distributions(real, synth, cat)).select(
        "feature", F.lit("js_distance").alias("metric"), F.col("js_distance").alias("value"))


@register_metric("correlation")
def _m_corr(real, synth, num, cat):
    return matrix_similarity(paired_matrices(real, synth, num)).select(
        F.lit(None).cast("string").alias("feature"), F.lit("frobenius_similarity").alias("metric"),
        F.col("frobenius_similarity").alias("value"))


def audit(real: DataFrame, synth: DataFrame, numeric: list[str], categorical: list[str],
          tests: list[str] | None = None) -> DataFrame:
    """Run the named metrics; a metric that fails to plan or run is
    isolated and reported with an error row instead of failing the audit.
    Each metric's few rows are written when it runs, so a failure in execution
    is its own."""
    parts = []
    spark = real.sparkSession
    for name in tests or list(METRICS):
        try:
            if name not in METRICS:
                raise KeyError(f"unknown test: {name}")
            part = METRICS[name](real, synth, numeric, categorical)
            part = part.select(F.lit(name).alias("test"), "feature", "metric",
                               F.col("value").cast("double").alias("value"), F.lit(None).cast("string").alias("error"))
            path = scratch_path(spark, "audit")
            part.write.parquet(path)
            parts.append(spark.read.schema(part.schema).parquet(path))
        except Exception as exc:  # isolate the failing test
            msg = exc.args[0] if isinstance(exc, KeyError) and exc.args else str(exc).splitlines()[0][:200]
            parts.append(spark.createDataFrame([(name, None, None, None, msg)],
                                               "test string, feature string, metric string, value double, error string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------------------
# The tables behind the distribution plots
# ---------------------------------------------------------------------------

def density_histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """(bin, lo, hi, count, density) over the column's own [min, max],
    last bin closed; every bin present."""
    d = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    st = d.agg(F.min("v").alias("mn"), F.max("v").alias("mx"), F.count(F.lit(1)).alias("n"))
    k = F.lit(1)
    w = (F.col("mx") - F.col("mn")) / bins
    b = d.withColumn("_k", k).join(F.broadcast(st.withColumn("_k", k)), "_k") \
        .select(F.least(F.floor((F.col("v") - F.col("mn")) / w), F.lit(bins - 1)).cast("int").alias("bin"))
    c = b.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    grid = st.select("mn", "mx", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    g = grid.join(c, "bin", "left").fillna(0, ["count"])
    return g.select("bin", (F.col("mn") + F.col("bin") * w).alias("lo"), (F.col("mn") + (F.col("bin") + 1) * w).alias("hi"),
                    "count", (F.col("count") / (F.col("n") * w)).alias("density"))


def box_stats(df: DataFrame, col: str) -> DataFrame:
    """Quartiles (linear), IQR, whiskers at the most extreme values inside
    1.5 IQR, and the outlier count."""
    from tabvet.operators.profile import quantiles
    d = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    q = quantiles(d, [], "v", [0.25, 0.5, 0.75]).groupBy().pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
    q = q.select(F.col("`0.25`").alias("q1"), F.col("`0.5`").alias("median"), F.col("`0.75`").alias("q3"))
    k = F.lit(1)
    j = d.withColumn("_k", k).join(F.broadcast(q.withColumn("_k", k)), "_k")
    iqr = F.col("q3") - F.col("q1")
    lo, hi = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    return j.groupBy("q1", "median", "q3").agg(
        F.min(F.when(F.col("v") >= lo, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < lo) | (F.col("v") > hi)).alias("outliers")) \
        .withColumn("iqr", F.col("q3") - F.col("q1"))


def qq_normal(df: DataFrame, col: str) -> DataFrame:
    """(i, theoretical, sample): sorted sample against normal quantiles of
    Filliben's order-statistic medians, one row per observation; positions
    come from the prefix-sum kernel, tie blocks expand to their positions."""
    from tabvet.functions.normal import phi_inv
    d = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    c = cumulative(d.groupBy("v").agg(F.count(F.lit(1)).alias("cnt")), [], "v", "cnt")
    e = c.select("v", F.col("tot_cnt").alias("n"),
                 F.explode(F.sequence(F.col("cum_cnt") - F.col("cnt") + 1, F.col("cum_cnt"))).alias("i"))
    n = F.col("n").cast("double")
    mn = F.pow(F.lit(0.5), 1.0 / n)
    m = (F.when(F.col("i") == F.col("n"), mn).when(F.col("i") == 1, 1.0 - mn)
         .otherwise((F.col("i") - 0.3175) / (n + 0.365)))
    return e.select("i", phi_inv(m).alias("theoretical"), F.col("v").alias("sample"))


def ecdf(df: DataFrame, col: str) -> DataFrame:
    """(value, ecdf) per distinct value."""
    d = df.select(F.col(col).cast("double").alias("v")).filter(F.col("v").isNotNull())
    c = cumulative(d.groupBy("v").agg(F.count(F.lit(1)).alias("cnt")), [], "v", "cnt")
    return c.select(F.col("v").alias("value"), (F.col("cum_cnt") / F.col("tot_cnt")).alias("ecdf"))
