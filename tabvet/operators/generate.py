"""Synthetic row generation and resampling.

Every draw is a hash uniform of (seed, output row id), so generation is
reproducible under re-execution and checkable in SQL.  Output rows come
from ``spark.range(n)`` (already partitioned); fitted distributions are
small tables (one row per category or condition group) joined in, and
the real rows used as conditions are reached through a dense index built
by the sequence kernel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.functions.hashing import hu, normal_draw
from tabvet.operators import sequence as S
from tabvet.operators.privacy import knn_pairs
from tabvet.operators.ranks import cumulative
from tabvet.session import cut_lineage, sized

def indexed(real: DataFrame, key: str) -> tuple[DataFrame, int]:
    """Dense 1..n index of the real rows in key order."""
    r = S.row_index(real.withColumn("_e", F.lit(0)), ["_e"], [key]).drop("_e")
    return r, real.count()


def bootstrap(spark, real: DataFrame, key: str, n: int, seed: int = 1) -> DataFrame:
    """K1: n rows drawn with replacement: row i takes real row
    floor(HU(seed, i) n_real) + 1."""
    r, nr = indexed(real, key)
    out = spark.range(n).withColumnRenamed("id", "row_id")
    out = out.withColumn("_r", (F.floor(hu(seed, "row_id") * nr) + 1).cast("long"))
    return out.join(r, "_r").drop("_r")


#: Stretches of a group's counts that draws and categories are joined on.
DRAW_RANGES = 1024


def categorical_table(real: DataFrame, col: str, given: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Empirical (conditional) category counts: (given..., _cat, _lo, _hi,
    _total), a category of the sorted ones owning the stretch [_lo, _hi) of
    its condition group's counts.  One row per category, never a list; a
    group's running sum is cut into ranges, so a group of very many
    categories is no single task.  ``weight``: column of counts."""
    given = given or []
    n = F.sum(weight) if weight else F.count(F.lit(1))
    c = real.filter(F.col(col).isNotNull()).groupBy(*given, F.col(col).cast("string").alias("_cat")).agg(n.alias("_n"))
    c = cumulative(c, given, "_cat", "_n", many_groups=bool(given))
    return c.select(*given, "_cat", (F.col("cum__n") - F.col("_n")).alias("_lo"), F.col("cum__n").alias("_hi"),
                    F.col("tot__n").alias("_total"))


def draw_categorical(df: DataFrame, table: DataFrame, given: list[str], out: str, row_id: str, seed: int) -> DataFrame:
    """K2 (re-aimed: the Gumbel-softmax head becomes a draw from the
    empirical, optionally conditional, frequencies): the category whose
    stretch holds HU(seed, row_id) x total.  Draws and categories meet by
    group and range of the counts."""
    stretch = F.sequence(F.greatest(F.expr(f"_lo * {DRAW_RANGES} div _total") - 1, F.lit(0)),
                         F.expr(f"_hi * {DRAW_RANGES} div _total") + 1)
    owned = sized(table.withColumn("_range", F.explode(stretch)).withColumnRenamed("_total", "_all"))
    if given:
        groups = table.groupBy(*given).agg(F.first("_total").alias("_total"))
        j = df.join(sized(groups), given, "left")
    else:
        one = F.lit(1)
        groups = table.agg(F.first("_total").alias("_total")).withColumn("_k", one)
        j = df.withColumn("_k", one).join(groups, "_k").drop("_k")
    at = hu(seed, row_id) * F.col("_total")
    j = j.withColumn("_at", at).withColumn("_pick", F.floor(F.col("_at") * DRAW_RANGES / F.col("_total")))
    on = [j[g] == owned[g] for g in given] + [j["_pick"] == owned["_range"], j["_at"] >= owned["_lo"], j["_at"] < owned["_hi"]]
    return j.join(owned, on, "left").select(*[j[c] for c in df.columns], owned["_cat"].alias(out))


def gaussian_table(real: DataFrame, col: str, given: list[str] | None = None) -> DataFrame:
    given = given or []
    return real.groupBy(*given).agg(F.avg(col).alias("_mu"), F.stddev_samp(col).alias("_sd"))


def draw_gaussian(df: DataFrame, table: DataFrame, given: list[str], out: str, row_id: str, seed: int) -> DataFrame:
    """K3: μ + σ z with z from Box-Muller over hash uniforms; (μ, σ) per
    condition group."""
    one = F.lit(1)
    j = df.join(sized(table), given, "left") if given else \
        df.withColumn("_k", one).join(F.broadcast(table.withColumn("_k", one)), "_k").drop("_k")
    z = normal_draw(seed, row_id)
    return j.withColumn(out, F.col("_mu") + F.coalesce(F.col("_sd"), F.lit(0.0)) * z).drop("_mu", "_sd")


def draw_mixture(df: DataFrame, weights: list[float], means: list[float], stds: list[float], out: str,
                 row_id: str, seed: int) -> DataFrame:
    """K4: component chosen by weight (inverse CDF), then a Gaussian draw
    with that component's mean and std."""
    cum, acc = [], 0.0
    for w in weights:
        acc += w
        cum.append(acc / sum(weights))
    u = hu(f"{seed}c", row_id)
    comp = F.lit(len(weights) - 1)
    for i in reversed(range(len(weights))):
        comp = F.when(u < F.lit(cum[i]), F.lit(i)).otherwise(comp)
    mu = F.element_at(F.array(*[F.lit(m) for m in means]), comp + 1)
    sd = F.element_at(F.array(*[F.lit(s) for s in stds]), comp + 1)
    return df.withColumn(f"{out}_component", comp).withColumn(out, mu + sd * normal_draw(seed, row_id))


def conditional_synthesis(spark, real: DataFrame, key: str, n: int, condition: str, categorical: list[str],
                          continuous: list[str], seed: int = 7) -> DataFrame:
    """K5: n rows exactly: a condition value bootstrapped from real rows
    (K1), then every categorical column drawn from its frequencies given
    the condition (K2) and every continuous column from the condition
    group's Gaussian (K3)."""
    base = bootstrap(spark, real, key, n, seed).select("row_id", condition)
    for i, c in enumerate(categorical):
        base = draw_categorical(base, categorical_table(real, c, [condition]), [condition], c, "row_id", f"{seed}:{i}")
    for i, c in enumerate(continuous):
        base = draw_gaussian(base, gaussian_table(real, c, [condition]), [condition], c, "row_id", f"{seed}:g{i}")
    return base


def smote(spark, df: DataFrame, target: str, minority, key: str, numeric: list[str], k: int = 5,
          seed: int = 42) -> DataFrame:
    """K6: n = len(y) - 2 * minority (>= 0) synthetic minority rows x + λ
    (x_nn - x), x a random minority row, x_nn one of its k nearest minority
    neighbours (exact grid kNN), λ ~ U(0, 1); other columns take the
    minority mode; skipped when the minority has fewer than k rows.
    Returns the input rows plus the synthetic ones (``synthetic`` flag)."""
    mino = df.filter(F.col(target) == F.lit(minority))
    n_min, n_all = mino.count(), df.count()
    n_syn = max(0, n_all - 2 * n_min)
    base = df.withColumn("synthetic", F.lit(False))
    if n_min < k or n_syn == 0:
        return base
    mino = cut_lineage(mino)            # read by six jobs
    idx, _ = indexed(mino, key)
    nbr = knn_pairs(mino.select(key, *numeric), numeric, key, k)
    out = spark.range(n_syn).withColumnRenamed("id", "row_id")
    out = out.withColumn("_r", (F.floor(hu(f"{seed}s", "row_id") * n_min) + 1).cast("long"))
    out = out.join(idx.select("_r", F.col(key).alias("_src"), *[F.col(c).alias(f"_x_{c}") for c in numeric]), "_r")
    out = out.withColumn("rank", (F.floor(hu(f"{seed}n", "row_id") * k) + 1).cast("int"))
    out = out.join(nbr.select(F.col(key).alias("_src"), "rank", "neighbor"), ["_src", "rank"])
    out = out.join(mino.select(F.col(key).alias("neighbor"), *[F.col(c).alias(f"_y_{c}") for c in numeric]), "neighbor")
    lam = hu(f"{seed}l", "row_id")
    others = [c for c in df.columns if c not in numeric and c != key]
    # most frequent value per column, the smallest of equals: counts first, so no task holds a column's values
    modes = {}
    for c in others:
        top = mino.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n")).agg(
            F.min(F.struct((-F.col("_n")).alias("n"), F.col(c).alias("v"))).alias("m")).first()["m"]
        modes[c] = top["v"] if top else None
    syn = out.select((F.lit(-1) - F.col("row_id")).cast(df.schema[key].dataType).alias(key),
                     *[(F.col(f"_x_{c}") + lam * (F.col(f"_y_{c}") - F.col(f"_x_{c}"))).alias(c) for c in numeric],
                     *[F.lit(modes[c]).cast(df.schema[c].dataType).alias(c) for c in others],
                     F.lit(True).alias("synthetic"))
    return base.unionByName(syn.select(*base.columns))
