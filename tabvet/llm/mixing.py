"""Operator 5: mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, lang, source).  The token budget goes down the tree: a
node's budget is shared among its children by weight, a child that cannot use
its share (the tokens of its leaves times ``max_epochs``) is filled up and its
shortage goes to its siblings by weight, so only what all siblings together
cannot take is missing one level up, where it was shared out before.  Every
leaf then takes the prefix, up to its budget, of its documents in a seeded
order that is new in each epoch.

Shares are whole tokens (integer division), so the result is the same in any
engine.  Only DataFrame functions: windows run over nodes and over hash
ranges, never over all documents of a leaf.

Defined results: NULL lang or source is the leaf "" ; a NULL or empty text has
0 tokens and is taken along with the prefix it falls in; a node without a
weight gets the default weight, one with weight 0 is left out; rows with equal
order keys (so with equal ids) are taken together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import BLANKS, body, column_names, stored

LEVELS = ("domain", "lang", "source")

#: Target weights of the registered query and the pipeline.
WEIGHTS = {
    "domain": {"web": 40, "forum": 15, "news": 25, "reference": 20},
    "lang": {"en": 60, "de": 15, "fr": 15, "es": 10},
    "source": {},
}
DEFAULT_WEIGHT = 5
#: Budget as a fraction of all tokens.
BUDGET = (3, 5)
SEED = 17
#: Hash ranges per leaf: only the range at a leaf's cut is looked at row by row.
RANGE_BITS = 12
KEY_BITS = 60


def domain_of(source: Column) -> Column:
    """Domain of a source name: src0 is web, src1-6 forum, src7-13 news, any
    other reference."""
    number = F.regexp_extract(source, "^src([0-9]{1,4})$", 1).try_cast("int")
    return (F.when(number == 0, "web").when(number <= 6, "forum").when(number <= 13, "news").otherwise("reference"))


def leaf_columns(docs: DataFrame) -> list[Column]:
    source = F.coalesce(docs["source"], F.lit(""))
    return [domain_of(source).alias("domain"), F.coalesce(docs["lang"], F.lit("")).alias("lang"),
            source.alias("source")]


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"[{BLANKS}]+", -1), lambda w: w != "")).cast("long")


def order_key(epoch: Column, doc_id: Column, seed: int) -> Column:
    """60-bit place of a document in an epoch's order."""
    said = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, KEY_BITS // 4), 16, 10).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Fill children by weight: in the order in which they fill up, each is
    full if what is left, shared by the weights left, reaches its capacity;
    the others share what the full ones leave."""
    wide = "decimal(38,0)"
    node = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by_fill = node.orderBy(F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(-1.0)), name)
    left = F.col("budget") - (F.sum("cap").over(by_fill) - F.col("cap"))
    weights = F.sum("w").over(node) - F.sum("w").over(by_fill) + F.col("w")
    full = left.cast(wide) * F.col("w").cast("decimal(18,0)") >= F.col("cap").cast(wide) * weights.cast("decimal(18,0)")
    placed = children.select("*", left.alias("_left"), weights.alias("_weights"), full.alias("_full"),
                             F.row_number().over(by_fill).alias("_n"))
    first = F.min(F.when(~F.col("_full"), F.struct("_n", "_left", "_weights"))).over(node)
    cut = placed.withColumn("_cut", first)
    part = F.expr("CAST((CAST(_cut._left AS DECIMAL(38,0)) * CAST(w AS DECIMAL(18,0))) div _cut._weights AS LONG)")
    return (cut.withColumn("share", F.when(F.col("_cut").isNull() | (F.col("_n") < F.col("_cut")["_n"]), F.col("cap"))
                           .otherwise(part))
            .drop("_left", "_weights", "_full", "_n", "_cut", "budget").withColumnRenamed("share", "budget"))


def budgets(units: DataFrame, budget: tuple[int, int] = BUDGET, max_epochs: int = 2,
            weights: dict[str, dict[str, int]] = WEIGHTS, default_weight: int = DEFAULT_WEIGHT) -> DataFrame:
    """Per leaf: tokens (available) and budget.  ``units``: domain, lang,
    source, tokens."""
    nodes = {3: units.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))}
    nodes[3] = nodes[3].withColumn("w", _weight("source", weights, default_weight)).withColumn(
        "cap", F.when(F.col("w") > 0, F.col("tokens") * max_epochs).otherwise(F.lit(0)))
    for k in (2, 1):
        nodes[k] = (nodes[k + 1].groupBy(*LEVELS[:k]).agg(F.sum("cap").alias("cap"))
                    .withColumn("w", _weight(LEVELS[k - 1], weights, default_weight))
                    .withColumn("cap", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0))))
    total = units.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"))
    root = (nodes[1].agg(F.sum("cap").alias("c")).withColumn("one", F.lit(0))
            .join(total.withColumn("one", F.lit(0)), "one"))
    root = root.select("one", F.least("c", F.expr(f"t * {budget[0]} div {budget[1]}")).alias("budget"))
    top = nodes[1].withColumn("one", F.lit(0)).join(root, "one").drop("one")
    shares = _share(top, [], "domain").select("domain", "budget")
    shares = _share(nodes[2].join(shares, ["domain"]), ["domain"], "lang").select("domain", "lang", "budget")
    return (_share(nodes[3].join(shares, ["domain", "lang"]), ["domain", "lang"], "source")
            .select(*LEVELS, "tokens", "budget"))


def cuts(units: DataFrame, leaves: DataFrame, seed: int = SEED) -> DataFrame:
    """Per leaf: full (epochs that take all its documents) and last (highest
    order key that the next epoch's prefix takes, -1 for none)."""
    leaves = leaves.select(*LEVELS, F.expr("IF(tokens > 0, budget div tokens, 0)").alias("full"),
                           F.expr("IF(tokens > 0, budget % tokens, 0)").alias("rest"))
    ranged = (units.join(leaves, list(LEVELS)).filter("rest > 0")
              .withColumn("key", order_key(F.col("full"), F.col("doc_id"), seed))
              .withColumn("range", F.shiftright("key", KEY_BITS - RANGE_BITS)))
    per_range = ranged.groupBy(*LEVELS, "rest", "range").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range"))
    at_cut = (per_range.withColumn("upto", upto).filter(F.col("upto") > F.col("rest"))
              .groupBy(*LEVELS, "rest").agg(F.min(F.struct("range", "upto", "n")).alias("c"))
              .select(*LEVELS, F.col("c.range").alias("range"),
                      (F.col("rest") - (F.col("c.upto") - F.col("c.n"))).alias("left")))
    keys = (ranged.drop("rest").join(at_cut, [*LEVELS, "range"])
            .groupBy(*LEVELS, "range", "left", "key").agg(F.sum("tokens").alias("n")))
    taken = keys.withColumn("upto", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("key")))
    last = taken.groupBy(*LEVELS, "range").agg(F.max(F.when(F.col("upto") <= F.col("left"), F.col("key"))).alias("key"))
    last = last.select(*LEVELS, F.coalesce("key", F.shiftleft("range", KEY_BITS - RANGE_BITS) - 1).alias("last"))
    return leaves.join(last, list(LEVELS), "left").select(*LEVELS, "full", F.coalesce("last", F.lit(-1)).alias("last"))


def copies(full: Column, last: Column, doc_id: Column, seed: int = SEED) -> Column:
    return full + F.when(order_key(full, doc_id, seed) <= last, 1).otherwise(0)


def units_of(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source and tokens of every row, stored without the texts."""
    return stored(docs.select(docs["doc_id"], *leaf_columns(docs), word_count(body(docs)).alias("tokens")), "mix-units")


def choose(docs: DataFrame, **params) -> DataFrame:
    """Per row: doc_id, domain, lang, source, n_tokens, copies (times it is
    taken, 0 for not at all)."""
    units = units_of(docs)
    plan = stored(cuts(units, budgets(units, **params)), "mix-cuts")
    return (units.join(plan, list(LEVELS))
            .select("doc_id", *LEVELS, F.col("tokens").alias("n_tokens"),
                    copies(F.col("full"), F.col("last"), F.col("doc_id")).alias("copies")))


def mix(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs``, each as often as the mixture takes it."""
    units = units_of(docs)
    plan = stored(cuts(units, budgets(units, **params)), "mix-cuts")
    names = column_names(docs, "_domain", "_lang", "_source", "_full", "_last", "_copy")
    keyed = docs.select("*", *[c.alias(n) for c, n in zip(leaf_columns(docs), names)])
    plan = plan.select(*[F.col(c).alias(n) for c, n in zip((*LEVELS, "full", "last"), names)])
    times = copies(F.col(names[3]), F.col(names[4]), F.col("doc_id"))
    taken = keyed.join(plan, names[:3]).withColumn(names[5], times).filter(F.col(names[5]) > 0)
    if params.get("max_epochs", 2) > 1:
        taken = taken.withColumn(names[5], F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[5]))))
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns])
