"""Operator 1: learned decision lists over text statistics.

``text_stats`` measures each text inside its own row with array functions;
``learn`` grows and prunes threshold conjunctions on labelled statistics by
sequential covering; ``verdict`` turns the list into one ordered conditional
expression.  Everything is DataFrame/SQL functions; the driver sees only
counts per (feature, bin).

Defined results: a NULL text is an empty one (no words, base rules fail it);
repeated rows are judged alike and all stay; with no labels, or none that a
rule can explain, the learned list is empty and only the base rules reject.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import BLANKS, body, column_names, stored

BLANK_RUN = r"[ \t\n\x0B\f\r]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50

#: Ratios that rules may test, each from the counts of ``text_stats``.
FEATURES = ("n_words", "word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio")


@dataclass(frozen=True)
class Condition:
    feature: str
    op: str          # ">=" or "<"
    value: float

    def column(self, s: Column) -> Column:
        x = feature(s, self.feature)
        return x >= F.lit(self.value) if self.op == ">=" else x < F.lit(self.value)

    def __str__(self):
        return f"{self.feature} {self.op} {self.value:g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float
    covered: int

    def column(self, s: Column) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column(s)
        return out

    def __str__(self):
        return " and ".join(map(str, self.conditions))


def _repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that occurs twice or more: windows are
    sorted with their positions, so equal ones are neighbours, and the
    covered stretches are added up in position order."""
    second = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    third = F.slice(words, 3, F.greatest(F.size(words), F.lit(1)))
    windows = F.filter(
        F.transform(F.arrays_zip(words.alias("a"), second.alias("b"), third.alias("c")),
                    lambda z, i: F.struct(F.concat_ws(" ", z["a"], z["b"], z["c"]).alias("w"), i.alias("i"))),
        lambda z: z["i"] < F.size(words) - 2)

    def positions(s: Column) -> Column:
        n = F.size(s)
        return F.array_sort(F.filter(
            F.transform(s, lambda z, k: F.when(
                ((k > 0) & (F.get(s, k - 1)["w"] == z["w"])) | ((k + 1 < n) & (F.get(s, k + 1)["w"] == z["w"])),
                z["i"])),
            lambda p: p.isNotNull()))

    def covered(pos: Column) -> Column:
        return F.aggregate(
            pos, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
            lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")),
            lambda a: a["n"])

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(
        F.get(F.transform(F.array(F.sort_array(windows)), lambda s: covered(positions(s))), 0))


def text_stats(text: Column) -> Column:
    """Struct of the base counts of one text (longs)."""
    words = F.filter(F.split(text, BLANK_RUN, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))

    def measured(w: Column, ln: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"))

    # one-element arrays bind the split texts once for all counts
    return F.get(F.transform(F.array(F.struct(words.alias("w"), lines.alias("l"))),
                             lambda b: measured(b["w"], b["l"])), 0)


def feature(s: Column, name: str) -> Column:
    """One rule feature as a double from the struct of ``text_stats``."""
    if name == "n_words":
        return s["n_words"].cast("double")
    over, under = {"word_length": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"),
                   "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}[name]
    return s[over].cast("double") / F.greatest(s[under], F.lit(1)).cast("double")


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def verdict(text: Column, rules: list[Rule]) -> Column:
    """Struct: the base counts, ``base_failed``, ``rule`` (number of the first
    rule that fires, from 1, else NULL) and ``kept``."""
    def judged(s: Column) -> Column:
        fired = F.lit(None).cast("int")
        for k in range(len(rules), 0, -1):
            fired = F.when(rules[k - 1].column(s), F.lit(k)).otherwise(fired)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return F.struct(*[s[n].alias(n) for n in names], base_failed(s).alias("base_failed"), fired.alias("rule"),
                        (~base_failed(s) & fired.isNull()).alias("kept"))

    return F.get(F.transform(F.array(text_stats(text)), judged), 0)


def training_profile(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, bins: int = 24,
                     seed: int = 7) -> tuple[DataFrame, dict[str, list[float]]]:
    """Counts of labelled texts per vector of feature bins: (bins, reject,
    part, n), part "grow" or "prune", and the thresholds per feature.

    Rules are fitted on at most ``max_labelled`` labelled texts, those with
    the smallest hash of their id; texts that the base rules fail anyway and
    rows without a label are left out.
    """
    picked = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(max_labelled)
              .select(F.col("doc_id").alias("_id"), (F.col("quality") == 0).alias("_reject")))
    plain = docs.select(docs["doc_id"].alias("_id"), body(docs).alias("_text"))
    stats = (plain.join(F.broadcast(picked), "_id").select("_id", "_reject", text_stats(F.col("_text")).alias("_s")))
    # stored before the filter, which would otherwise measure all texts below the join
    rows = stored(
        stats.select(*[feature(F.col("_s"), f).alias(f) for f in FEATURES], F.col("_reject").alias("reject"),
                F.when(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_id")), F.lit(3)) == 0, "prune")
                .otherwise("grow").alias("part"), base_failed(F.col("_s")).alias("failed")),
        "quality-rules").filter("not failed")
    cuts = [0.002, 0.005, 0.01, 0.02, *(k / bins for k in range(1, bins)), 0.98, 0.99, 0.995, 0.998]
    head = rows.agg(*[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).head()
    per_reject = rows.filter("reject").agg(
        *[F.percentile_approx(f, cuts, 10_000).alias(f) for f in FEATURES]).head()
    thresholds = {f: sorted({float(v) for v in (head[f] or []) + (per_reject[f] or [])}) for f in FEATURES}
    def bin_of(f: str) -> Column:
        cuts_of = F.array(*[F.lit(t) for t in thresholds[f]]).cast("array<double>")
        return F.size(F.filter(cuts_of, lambda t: t <= F.col(f)))

    binned = F.array(*map(bin_of, FEATURES))
    profile = stored(rows.select(binned.alias("bins"), "reject", "part")
                     .groupBy("bins", "reject", "part").agg(F.count(F.lit(1)).alias("n")), "quality-profile")
    return profile, thresholds


def learn(profile: DataFrame, thresholds: dict[str, list[float]], max_rules: int = 8, max_conditions: int = 3,
          min_precision: float = 0.9, min_covered: int = 10) -> list[Rule]:
    """Sequential covering on the profile: grow the conjunction with the best
    information gain on the "grow" rows, cut trailing conditions that do not
    pay on the "prune" rows, accept it while its precision over both parts
    reaches ``min_precision``, and go on with the rows it does not cover."""
    index = {f: k for k, f in enumerate(FEATURES)}

    def holds(c: Condition) -> Column:
        cut = thresholds[c.feature].index(c.value)
        b = F.get(F.col("bins"), index[c.feature])
        return b > cut if c.op == ">=" else b <= cut

    def all_of(cs) -> Column:
        out = F.lit(True)
        for c in cs:
            out = out & holds(c)
        return out

    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        grown: list[Condition] = []
        while len(grown) < max_conditions:
            found = _best(profile.filter(left & all_of(grown) & (F.col("part") == "grow")), thresholds)
            if found is None or found[0] in grown:
                break
            grown.append(found[0])
            if found[1] == 0:
                break
        if not grown:
            break
        sizes = []
        for k in range(1, len(grown) + 1):
            c = all_of(grown[:k])
            for part in ("grow", "prune"):
                for reject in (True, False):
                    sizes.append(F.sum(F.when(c & (F.col("part") == part) & (F.col("reject") == reject),
                                              F.col("n")).otherwise(0)))
        row = profile.filter(left).agg(*[s.alias(f"s{i}") for i, s in enumerate(sizes)]).head()
        counts = [tuple(int(row[4 * k + j] or 0) for j in range(4)) for k in range(len(grown))]
        worth = [((pp - pn) / (pp + pn) if pp + pn else -1.0) for _, _, pp, pn in counts]
        keep = max(range(len(grown)), key=lambda k: (worth[k], -k)) + 1
        gp, gn, pp, pn = counts[keep - 1]
        covered, precision = gp + pp, (gp + pp) / max(gp + gn + pp + pn, 1)
        if precision < min_precision or covered < min_covered or (pp + pn and pp / (pp + pn) < min_precision):
            break
        rules.append(Rule(tuple(grown[:keep]), round(precision, 4), covered))
        left = left & ~all_of(grown[:keep])
    return rules


def _best(rows: DataFrame, thresholds: dict[str, list[float]]) -> tuple[Condition, int] | None:
    """The condition of highest gain p1 (log2 precision after - before) and
    the clean texts it still covers."""
    got = (rows.select(F.posexplode("bins").alias("f", "bin"), "reject", "n")
           .groupBy("f", "bin").agg(F.sum(F.when(F.col("reject"), F.col("n")).otherwise(0)).alias("p"),
                                    F.sum(F.when(F.col("reject"), 0).otherwise(F.col("n"))).alias("q")).collect())
    best, best_gain, best_q = None, 1e-9, 0
    for k, f in enumerate(FEATURES):
        cells = {r["bin"]: (int(r["p"]), int(r["q"])) for r in got if r["f"] == k}
        p0, q0 = (sum(x[j] for x in cells.values()) for j in (0, 1))
        if p0 == 0:
            return None
        for cut, value in enumerate(thresholds[f]):
            below = [sum(x[j] for b, x in cells.items() if b <= cut) for j in (0, 1)]
            for op, (p, q) in ((">=", (p0 - below[0], q0 - below[1])), ("<", tuple(below))):
                if p == 0 or (p, q) == (p0, q0):
                    continue
                gain = p * (math.log2(p / (p + q)) - math.log2(p0 / (p0 + q0)))
                if gain > best_gain + 1e-9:
                    best, best_gain, best_q = Condition(f, op, value), gain, q
    return (best, best_q) if best else None


def learned_rules(docs: DataFrame, labels: DataFrame, **params) -> list[Rule]:
    return learn(*training_profile(docs, labels), **params)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the rule that fired."""
    return docs.select(docs["doc_id"], verdict(body(docs), rules).alias("_v")).select("doc_id", "_v.*")


def keep(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``docs`` that the base rules and the list keep."""
    (name,) = column_names(docs, "_verdict")
    return docs.withColumn(name, verdict(body(docs), rules)["kept"]).filter(F.col(name)).drop(name)
