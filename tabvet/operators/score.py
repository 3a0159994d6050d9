"""Row scoring, triage and validate-and-heal.

Probability tables (priors, conditionals, BDeu) are grouped counts; each
row looks its values up with joins (broadcast only under a checked row
count).  Scores are Column arithmetic, so a whole table is scored in one
plan rather than row by row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.session import sized
from tabvet.operators import heal as HL

def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _join_checked(df: DataFrame, side: DataFrame, on, how="left") -> DataFrame:
    return df.join(sized(side), on, how)


# H1 / H2 / H3 -----------------------------------------------------------------

def prior(reference: DataFrame, col: str) -> DataFrame:
    """H1: (value, p) = share of each value among non-null values."""
    c = reference.filter(_c(col).isNotNull()).groupBy(_c(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    tot = c.agg(F.sum("n").alias("t"))
    return c.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k") \
        .select("v", (F.col("n") / F.col("t")).alias("p"))


def conditional(reference: DataFrame, child: str, parents: list[str], joint: bool = False) -> DataFrame:
    """H2: (parent values..., v, p).  ``joint=True`` gives the reference
    behaviour (joint frequency of parents and child); the default is the
    true conditional P(child | parents) = n(parents, v) / n(parents)."""
    keys = [_c(p).alias(f"p{i}") for i, p in enumerate(parents)]
    d = reference.select(*keys, _c(child).alias("v")).dropna()
    c = d.groupBy(*[f"p{i}" for i in range(len(parents))], "v").agg(F.count(F.lit(1)).alias("n"))
    if joint:
        tot = c.agg(F.sum("n").alias("t"))
        return c.withColumn("_k", F.lit(1)).join(F.broadcast(tot.withColumn("_k", F.lit(1))), "_k") \
            .select(*[f"p{i}" for i in range(len(parents))], "v", (F.col("n") / F.col("t")).alias("p"))
    pk = [f"p{i}" for i in range(len(parents))]
    tot = c.groupBy(*pk).agg(F.sum("n").alias("t"))
    return c.join(tot, pk).select(*pk, "v", (F.col("n") / F.col("t")).alias("p"))


def bdeu(reference: DataFrame, child: str, parents: list[str], ess: float = 5.0) -> tuple[DataFrame, DataFrame, float, int]:
    """H3: BDeu-smoothed conditional with equivalent sample size ``ess``:
    P = (n_ijk + ess/(q r)) / (n_ij + ess/q), r = child states, q = parent
    configurations (product of parent cardinalities).  Returns the cell
    counts, the parent-configuration counts, q and r; unseen cells are
    scored from these without materialising the full domain."""
    pk = [f"p{i}" for i in range(len(parents))]
    d = reference.select(*[_c(p).alias(k) for p, k in zip(parents, pk)], _c(child).alias("v")).dropna()
    cells = d.groupBy(*pk, "v").agg(F.count(F.lit(1)).alias("n_ijk"))
    cfg = d.groupBy(*pk).agg(F.count(F.lit(1)).alias("n_ij"))
    card = d.agg(*[F.count_distinct(k).alias(k) for k in pk], F.count_distinct("v").alias("r")).first()
    q = int(reduce(lambda a, b: a * b, [card[k] for k in pk], 1))
    return cells, cfg, float(ess), (q, int(card["r"]))


def bdeu_probability(df: DataFrame, child: str, parents: list[str], model) -> Column:
    """Row lookup of a BDeu model (needs ``attach_bdeu`` columns)."""
    _, _, ess, (q, r) = model
    return (F.coalesce(F.col(f"_n_ijk_{child}"), F.lit(0)) + ess / (q * r)) / \
        (F.coalesce(F.col(f"_n_ij_{child}"), F.lit(0)) + ess / q)


def attach_bdeu(df: DataFrame, child: str, parents: list[str], model) -> DataFrame:
    cells, cfg, _, _ = model
    pk = [f"p{i}" for i in range(len(parents))]
    d = df.select("*", *[_c(p).alias(k) for p, k in zip(parents, pk)], _c(child).alias("_v"))
    d = _join_checked(d, cells.withColumnRenamed("v", "_v").withColumnRenamed("n_ijk", f"_n_ijk_{child}"), [*pk, "_v"])
    d = _join_checked(d, cfg.withColumnRenamed("n_ij", f"_n_ij_{child}"), pk)
    return d.drop(*pk, "_v")


# H4 ----------------------------------------------------------------------------

class BayesianScorer:
    """Row likelihood = geometric mean over graph nodes of P(node | parents)
    (or the prior for roots); unseen values score 1e-5, every factor is
    floored at 1e-10, the result clamped to [0, 1]; 0.5 without nodes."""

    def __init__(self, edges: list[tuple[str, str]], nodes: list[str] | None = None, joint: bool = False):
        self.edges = list(edges)
        self.nodes = list(nodes) if nodes is not None else sorted({x for e in edges for x in e})
        self.joint = joint
        self.tables: dict[str, DataFrame] = {}

    def parents(self, node: str) -> list[str]:
        return [a for a, b in self.edges if b == node]

    def fit(self, reference: DataFrame) -> "BayesianScorer":
        for n in self.nodes:
            if n not in reference.columns:
                continue
            ps = [p for p in self.parents(n) if p in reference.columns]
            self.tables[n] = conditional(reference, n, ps, self.joint) if ps else prior(reference, n)
        return self

    def score(self, df: DataFrame, out: str = "row_probability") -> DataFrame:
        d = df
        logs = []
        for n, tbl in self.tables.items():
            if n not in df.columns:
                continue
            ps = [p for p in self.parents(n) if p in df.columns]
            pk = [f"p{i}" for i in range(len(ps))]
            d = d.select("*", *[_c(p).alias(f"_{n}_{k}") for p, k in zip(ps, pk)], _c(n).alias(f"_{n}_v"))
            t = tbl.select(*[F.col(k).alias(f"_{n}_{k}") for k in pk], F.col("v").alias(f"_{n}_v"),
                           F.col("p").alias(f"_{n}_p"))
            d = _join_checked(d, t, [*[f"_{n}_{k}" for k in pk], f"_{n}_v"])
            p = F.coalesce(F.col(f"_{n}_p"), F.lit(1e-5))
            logs.append(F.log(F.greatest(p, F.lit(1e-10))))
        if not logs:
            return df.withColumn(out, F.lit(0.5))
        avg = sum(logs) / len(logs)
        prob = F.least(F.greatest(F.exp(avg), F.lit(0.0)), F.lit(1.0))
        return d.select(*[_c(c) for c in df.columns], prob.alias(out))


# H5, H6, H7 -------------------------------------------------------------------

class EntropyScorer:
    """B10 fit + H5: categorical columns (text, or fewer than 20 distinct
    values) score 0.3 for unseen values, 0.6 below p = 0.01, else
    min(1, -ln p / 5); numeric columns by |z| bands 1 / 0.8 / 0.6 / 0.3;
    the row score is the mean over scored columns (0.5 if none).
    (Rarer categories score higher, as documented by the reference.)"""

    def __init__(self):
        self.cat: dict[str, DataFrame] = {}
        self.num: dict[str, tuple[float, float]] = {}

    def fit(self, reference: DataFrame, cols: list[str]) -> "EntropyScorer":
        nun = reference.agg(*[F.count_distinct(_c(c)).alias(c) for c in cols]).first()
        num_cols = []
        for c in cols:
            if reference.schema[c].dataType.simpleString() == "string" or nun[c] < 20:
                self.cat[c] = prior(reference, c)
            else:
                num_cols.append(c)
        if num_cols:
            row = reference.agg(*[F.avg(_c(c)).alias(f"m_{c}") for c in num_cols],
                                *[F.stddev_samp(_c(c)).alias(f"s_{c}") for c in num_cols]).first()
            for c in num_cols:
                self.num[c] = (row[f"m_{c}"], row[f"s_{c}"] or 0.0)
        return self

    def score(self, df: DataFrame, out: str = "entropy_score") -> DataFrame:
        d = df
        parts = []
        for c, tbl in self.cat.items():
            if c not in df.columns:
                continue
            d = _join_checked(d.withColumn(f"_{c}_v", _c(c)),
                              tbl.select(F.col("v").alias(f"_{c}_v"), F.col("p").alias(f"_{c}_p")), f"_{c}_v")
            p = F.coalesce(F.col(f"_{c}_p"), F.lit(0.0))
            parts.append(F.when(p == 0, 0.3).when(p < 0.01, 0.6).otherwise(F.least(F.lit(1.0), -F.log(p) / 5.0)))
        for c, (m, s) in self.num.items():
            if c not in df.columns:
                continue
            z = F.abs((_c(c).cast("double") - F.lit(m)) / F.lit(s + 1e-10))
            parts.append(F.when(z < 1, 1.0).when(z < 2, 0.8).when(z < 3, 0.6).otherwise(0.3))
        score = (sum(parts) / len(parts)) if parts else F.lit(0.5)
        return d.select(*[_c(c) for c in df.columns], score.alias(out))


def confidence(bayes_p: Column, soft: Column, entropy: Column, n_corrections: Column) -> Column:
    """H6: .2 min(10 p, 1) + .5 soft + .3 entropy - .05 min(1, .08 n),
    clamped to [0, 1]."""
    c = (0.2 * F.least(bayes_p * 10.0, F.lit(1.0)) + 0.5 * soft + 0.3 * entropy
         - 0.05 * F.least(F.lit(1.0), n_corrections * 0.08))
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def triage(conf: Column, n_corrections: Column, threshold: float) -> Column:
    """H7: at or above the threshold -> corrected (if changed) / valid;
    otherwise discarded."""
    return F.when(conf >= threshold, F.when(n_corrections > 0, "corrected").otherwise("valid")).otherwise("discarded")


# H8-H10 -------------------------------------------------------------------------

def validate_and_heal(df: DataFrame, reference: DataFrame, rules, key: str, heal_vars: dict[str, list[str]],
                      bayes: BayesianScorer, entropy: EntropyScorer, groups: list | None = None,
                      count_like: list[str] | None = None, threshold: float = 0.85,
                      strategy: str = "aggressive", jitter: float = 0.0) -> DataFrame:
    """H8: hard/soft rules (E23) -> contextual healing of the first healable
    variable of each violated rule (G9, one-hot winner G10) -> group repair
    of violating rows (G7) -> likelihood (H4), entropy (H5), confidence (H6) -> count clamp
    (G12) -> triage (H7).  ``aggressive`` drops discarded rows,
    ``conservative`` keeps their original values.  Output: the table's
    columns plus the audit trail (H10): status, confidence, entropy,
    violations, corrections."""
    cols = list(df.columns)
    checked = rules.check(df).withColumnRenamed("violations", "_viol0").withColumnRenamed("soft_score", "_soft0")
    healed = checked.select("*", *[_c(c).alias(f"_orig_{c}") for c in cols if c != key])
    for rule_name, variables in heal_vars.items():
        viol = F.array_contains(F.col("_viol0"), rule_name)
        target = next((v for v in variables if v in df.columns and v in reference.columns), None)
        if target is None:
            continue
        if any(c.startswith(target + "_") for c in reference.columns):
            healed = HL.onehot_winner(healed, target, viol)
            healed = healed.withColumn(f"_corr_{rule_name}", F.when(viol, F.lit(f"{target} group: enforced logical winner")))
        else:
            healed = HL.contextual_heal(healed, reference, target, viol, variables, key, jitter)
            healed = healed.withColumn(f"_corr_{rule_name}", F.when(F.col(f"_healed_{target}"),
                                                                    F.lit(f"{target}: contextual healing"))) \
                .drop(f"_healed_{target}")
    corr_cols = [c for c in healed.columns if c.startswith("_corr_")]
    corrections = F.array_compact(F.array(*[F.col(c) for c in corr_cols])) if corr_cols else \
        F.array().cast("array<string>")
    healed = healed.withColumn("corrections", corrections).drop(*corr_cols)
    if groups:
        healed = HL.repair_groups(healed, groups, reference, only=F.size("_viol0") > 0)
    scored = bayes.score(healed, "_bayes")
    scored = entropy.score(scored, "entropy_score")
    ncorr = F.size("corrections")
    conf = confidence(F.col("_bayes"), F.col("_soft0"), F.col("entropy_score"), ncorr)
    scored = scored.withColumn("confidence", conf).withColumn("status", triage(F.col("confidence"), ncorr, threshold))
    if count_like:
        scored = HL.nonnegative_integer(scored, [c for c in count_like if c in cols])
    discarded = F.col("status") == "discarded"
    out_cols = [F.when(discarded, F.col(f"_orig_{c}")).otherwise(_c(c)).alias(c) if c != key else _c(c) for c in cols]
    res = scored.select(*out_cols, "status", "confidence", "entropy_score", F.col("_viol0").alias("violations"),
                   "corrections")
    if strategy == "aggressive":
        res = res.filter(~discarded)
    return res


def health_report(trail: DataFrame) -> DataFrame:
    """H9: counts by status and health = (valid + corrected) / total x 100
    (100 for an empty table)."""
    a = trail.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(F.col("status") == "valid").alias("valid_rows"),
                  F.count_if(F.col("status") == "corrected").alias("corrected_rows"),
                  F.count_if(F.col("status") == "discarded").alias("discarded_rows"))
    return a.withColumn("health_score", F.when(F.col("total_rows") == 0, F.lit(100.0)).otherwise(
        (F.col("valid_rows") + F.col("corrected_rows")) / F.col("total_rows") * 100.0))
