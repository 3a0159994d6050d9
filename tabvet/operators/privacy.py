"""Privacy metrics.

Nearest neighbours come from ``neighbours`` (exact, adaptive cells).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.functions.hashing import hu
from tabvet.operators import forest, neighbours
from tabvet.operators.ranks import cumulative


def knn(query: DataFrame, base: DataFrame, cols: list[str], qkey: str, k: int = 5,
        exclude_self: str | None = None) -> DataFrame:
    """k nearest base rows (L2 over ``cols``) for each query row: (qkey,
    kth_distance, mean_distance).  With ``exclude_self`` the query rows are
    base rows, and a row does not count as its own neighbour."""
    return neighbours.kth(query, base, cols, qkey, k, own=bool(exclude_self))


def knn_pairs(df: DataFrame, cols: list[str], key: str, k: int) -> DataFrame:
    """(key, neighbor, distance, rank) for the k nearest other rows of the
    same table (ties by key)."""
    return neighbours.pairs(df, cols, key, k)


def nn_distance(real: DataFrame, synth: DataFrame, cols: list[str], skey: str, k: int = 5) -> DataFrame:
    """Mean over synthetic rows of the mean distance to their k nearest
    real rows."""
    d = knn(synth.select(skey, *cols).dropna(), real.select(*cols).dropna(), cols, skey, k)
    return d.agg(F.avg("mean_distance").alias("average_nearest_neighbor_distance"))


def overlap_ratio(real: DataFrame, synth: DataFrame, cols: list[str], rkey: str, skey: str) -> DataFrame:
    """Pooled rows; a row counts when its nearest other row (ties at the
    same distance: the lowest pooled id, real rows before synthetic, then
    by key) belongs to the other table; privacy = max(0, 1 - ratio)."""
    pooled = (real.select(F.lit(0).alias("side"), F.col(rkey).cast("long").alias("k"), *cols)
              .unionByName(synth.select(F.lit(1).alias("side"), F.col(skey).cast("long").alias("k"), *cols)).dropna())
    pooled = pooled.withColumn("pid", F.col("side") * F.lit(10 ** 12) + F.col("k"))
    near = knn_pairs(pooled, cols, "pid", 1)
    crosses = (F.col("pid") < 10 ** 12) != (F.col("neighbor") < 10 ** 12)
    ratio = near.agg((F.count_if(crosses) / F.count(F.lit(1))).alias("data_overlap_ratio"))
    return ratio.withColumn("privacy_score", F.greatest(F.lit(0.0), 1.0 - F.col("data_overlap_ratio")))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by the rank form (Mann-Whitney U) with average ranks
    for tied scores; ranks from the prefix-sum kernel."""
    d = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("int").alias("y")).dropna()
    vc = d.groupBy("s").agg(F.count(F.lit(1)).alias("cnt"), F.sum("y").alias("pos"))
    c = cumulative(vc, [], "s", "cnt")
    avg_rank = F.col("cum_cnt") - F.col("cnt") + (F.col("cnt") + 1) / 2.0
    a = c.agg(F.sum(avg_rank * F.col("pos")).alias("rsum"), F.sum("pos").alias("n1"), F.sum("cnt").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return a.select(((F.col("rsum") - n1 * (n1 + 1) / 2.0) / (n1 * n0)).alias("auc"))


def unique_value_overlap(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct text values pooled over ``cols``: |real ∩ synth| / |real|."""
    def vals(df):
        return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in cols])).alias("v")) \
            .filter(F.col("v").isNotNull()).distinct()
    r, s = vals(real), vals(synth)
    inter = r.join(s, "v", "left_semi")
    nr = r.agg(F.count(F.lit(1)).alias("nr"))
    ni = inter.agg(F.count(F.lit(1)).alias("ni"))
    return nr.withColumn("_k", F.lit(1)).join(ni.withColumn("_k", F.lit(1)), "_k").select(
        F.when(F.col("nr") > 0, F.col("ni") / F.col("nr")).otherwise(F.lit(0.0)).alias("unique_value_overlap"))


def rare_pattern_overlap(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Share of the real table's distinct rows (over ``cols``, NULL equal
    to NULL) that occur in the synthetic one."""
    r = real.select(*cols).distinct()
    s = synth.select(*[F.col(c).alias(f"s_{c}") for c in cols]).distinct().withColumn("_hit", F.lit(1))
    same = [r[c].eqNullSafe(s[f"s_{c}"]) for c in cols]
    return r.join(s, same, "left").agg(F.coalesce(F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
                                       .alias("rare_pattern_overlap"))


def exact_copies(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """Synthetic rows equal to some real row on every column (NULLs
    match NULLs), a full semi join on all columns."""
    return synth.alias("s").join(real.select(*cols).distinct().alias("r"),
                                 [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cols], "left_semi")


def mean_difference_score(real: DataFrame, synth: DataFrame, cols: list[str]) -> DataFrame:
    """1 / (1 + mean over columns of |mean_real - mean_synth|); 1 when
    nothing is comparable."""
    a = real.agg(*[F.avg(c).alias(c) for c in cols]).withColumn("_k", F.lit(1))
    b = synth.agg(*[F.avg(c).alias(f"s_{c}") for c in cols]).withColumn("_k", F.lit(1))
    j = a.join(b, "_k")
    diffs = [F.abs(F.col(c) - F.col(f"s_{c}")) for c in cols]
    md = sum(diffs) / len(diffs)
    return j.select(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 / (1.0 + md))).alias("privacy_score"))


def dp_bounds(runs: DataFrame) -> DataFrame:
    """Per run (noise_scale, batch_size, dataset_size, iterations):
    δ = 1/N, ε = noise sqrt(2 T ln(1.25/δ)) / batch ('as documented'; no
    formal DP claim), budget min(ε, 10)."""
    delta = 1.0 / F.col("dataset_size").cast("double")
    eps = F.col("noise_scale") * F.sqrt(2.0 * F.col("iterations") * F.log(1.25 / delta)) / F.col("batch_size")
    return runs.select("*", eps.alias("epsilon"), delta.alias("delta"), F.least(eps, F.lit(10.0)).alias("privacy_budget_used"))


def dp_report(bounds: DataFrame) -> DataFrame:
    """J9 report: average / max ε, average δ and the ε band."""
    a = bounds.agg(F.avg("epsilon").alias("avg_epsilon"), F.max("epsilon").alias("max_epsilon"),
                   F.avg("delta").alias("avg_delta"))
    e = F.col("avg_epsilon")
    return a.withColumn("interpretation", F.when(e < 1.0, "Strong differential privacy (e < 1)")
                        .when(e < 3.0, "Acceptable differential privacy (e < 3)")
                        .when(e < 10.0, "Weak differential privacy (e < 10)").otherwise("Insufficient differential privacy"))


#: Rows that one task of a forest is given at least and at most, and the tasks beyond which it is given more than
#: the least: each task sends the statistics of all nodes of a level.
TASK_ROWS, MOST_ROWS, TASKS = 50_000, 1_000_000, 24


def _tasks(rows: int) -> int:
    return max(min(rows // TASK_ROWS, TASKS), rows // MOST_ROWS)


def _spread(data: DataFrame, rows: int, cols: list[str]) -> DataFrame:
    """``data`` in as many parts as its rows ask for, however its files are
    cut; parts and their order depend on the values alone, as the forests'
    bootstrap counts rows by part.  Few rows stay as they are."""
    tasks = _tasks(rows)
    return data.repartition(tasks, *cols).sortWithinPartitions(*cols) if tasks > 1 else data


def membership_risk(train: DataFrame, holdout: DataFrame, synth: DataFrame, cols: list[str], n_shadow: int = 3,
                    trees: int = 100, depth: int = 10, seed: int = 42) -> DataFrame:
    """Shadow random forests separating (train ∪ synthetic) members
    from held-out rows, balanced by class weights; AUC on a hash-split 30 %
    evaluation part; mean / std over shadow models.  Where rows are many and
    their features' bins make few cells, the forests are grown from counts."""
    members = train.select(*cols).unionByName(synth.select(*cols)).withColumn("label", F.lit(1.0))
    non = holdout.select(*cols).withColumn("label", F.lit(0.0))
    data = members.unionByName(non).dropna()
    counts = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}
    tot = sum(counts.values())
    weights = [tot / (2.0 * counts.get(c, 1)) for c in (0.0, 1.0)]
    row_text = F.concat_ws("|", "label", *[F.col(c).cast("string") for c in cols])
    learnt = [hu(seed + i, row_text) >= 0.3 for i in range(n_shadow)]  # deterministic split, stable under re-execution
    aucs = None
    if _tasks(tot) > 1 and n_shadow < 63:
        aucs = _counted_aucs(data, cols, weights, tot, learnt, trees, depth, seed)
    if aucs is None:
        aucs = _forest_aucs(data, cols, weights, tot, learnt, trees, depth, seed)
    spark = train.sparkSession
    mean = sum(aucs) / len(aucs)
    std = (sum((a - mean) ** 2 for a in aucs) / len(aucs)) ** 0.5
    return spark.createDataFrame([(float(mean), float(std), len(aucs))], "auc_mean double, auc_std double, n_shadow int")


def _counted_aucs(data: DataFrame, cols: list[str], weights: list[float], rows: int, learnt: list[Column], trees: int,
                  depth: int, seed: int) -> list[float] | None:
    """The forests from counts of cells; None if a forest has too many cells."""
    parts = sum((F.when(u, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, u in enumerate(learnt)), F.lit(0).cast("long"))
    data = data.repartition(_tasks(rows), "label", *cols).select(
        "label", parts.alias("parts"), *[F.col(c).cast("double").alias(c) for c in cols]).cache()
    try:
        splits = forest.bounds(data, cols, weights, len(learnt))
        if max(forest.cells(s) for s in splits) > forest.MOST_CELLS:
            return None
        out = []
        for i, (held, known) in enumerate(forest.counts(data, cols, splits)):
            score = forest.votes(known, [len(s) + 1 for s in splits[i]], weights, trees, depth, seed + i)
            out.append(forest.auc(score, held))
        return out
    finally:
        data.unpersist()


def _forest_aucs(data: DataFrame, cols: list[str], weights: list[float], rows: int, learnt: list[Column], trees: int,
                 depth: int, seed: int) -> list[float]:
    """The forests by Spark's own learner."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=cols, outputCol="features").transform(data)
    wcol = F.when(F.col("label") == 1.0, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    data = _spread(data.withColumn("w", wcol), rows, ["label", *cols]).cache()
    aucs = []
    for i, u in enumerate(learnt):
        rf = RandomForestClassifier(numTrees=trees, maxDepth=depth, weightCol="w", seed=seed + i)
        model = rf.fit(data.filter(u))
        aucs.append(BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(model.transform(data.filter(~u))))
    data.unpersist()
    return aucs


def risk_band(auc: Column, rare: Column, unique: Column) -> Column:
    """AUC <= .55 and rare < .2 -> low; AUC <= .65 or unique < .3 ->
    medium; else high."""
    return F.when((auc <= 0.55) & (rare < 0.2), "low").when((auc <= 0.65) | (unique < 0.3), "medium").otherwise("high")
