"""Operator 13: a Merkle manifest of a dataset from concatenated-level strings.

Every row is a leaf: the SHA-256 of its length-prefixed fields.  Leaves of a
language ascend by doc_id; every 8 consecutive nodes become their hash until
one is left, the language's subroot; the subroots, ordered by language, make
the root the same way.

A block is 512 aligned leaves.  It keeps each of its levels as one hex string,
64 characters a node: fixed-width substrings of 512 characters hash to the next
level, and what flanks a node inside its 512 characters are its siblings.  Block
tops are the leaves of the next round, until every language has one node, so
no task holds more than a block and nothing but the number of rounds is read by
the driver.

Positions come from a range partitioning (language, doc_id, leaf) whose
partitions are counted, not from a window over a language.

Defined results: NULL fields hash as ``-``; the NULL language comes first; rows
with a NULL doc_id come first in their language and are never tampered with;
rows with equal language and doc_id ascend by leaf, and equal rows are leaves of
their own (which of them takes which place makes no difference to the set of
results); an empty table has no rows and no root; a language of one row has its
leaf as subroot; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import stored
from tabvet.session import sized

FANOUT = 8
#: Levels of a block: 8^3 leaves.
LEVELS = 3
BLOCK = FANOUT ** LEVELS
HEX = 64
#: Leaves a range partition takes (some 200 bytes each).
PARTITION_ROWS = 200_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(docs: DataFrame, **changed: Column) -> Column:
    return digest(F.concat(*[field(changed.get(c, docs[c])) for c in FIELDS]))


def chosen(doc_id: Column) -> Column:
    """Rows to tamper with: the crc32 of the decimal doc_id divides by 3."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 0, F.lit(False))


def lower_cased(docs: DataFrame) -> Column:
    """The leaf that a row presents after tampering: text with A-Z lowered."""
    return F.when(chosen(docs["doc_id"]), leaf(docs, text=F.translate(docs["text"], UPPER, LOWER)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond


def positions(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` (small rows, written already) with ``pos``, the place of each row
    in its group by ``order``, and ``size``, the rows of the group."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // PARTITION_ROWS))
    # the random last key lets equal rows lie in several partitions
    ranged = (df.withColumn("_salt", F.rand(13)).repartitionByRange(n, *group, *order, "_salt")
              .sortWithinPartitions(*group, *order).drop("_salt")
              .withColumn("_at", F.monotonically_increasing_id()))
    ranged = stored(ranged.withColumn("_part", F.shiftright("_at", 33)), name)
    parts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    keys = ", ".join(f"`{g}`" for g in group) or "1"
    parts = parts.selectExpr(
        *[f"`{g}` AS `_g{k}`" for k, g in enumerate(group)], "_part AS _p",
        f"sum(_rows) OVER (PARTITION BY {keys} ORDER BY _part) - _rows - _first AS _shift",
        f"sum(_rows) OVER (PARTITION BY {keys}) AS size")
    side = sized(parts)
    cond = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return (ranged.join(side, cond).withColumn("pos", F.col("_at") + F.col("_shift"))
            .drop("_at", "_part", "_p", "_shift", *[f"_g{k}" for k in range(len(group))]))


def _parents(level: Column) -> Column:
    """The level above a level string: the hash of every 512 characters."""
    width = FANOUT * HEX
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / width).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(level, r * width + 1, F.lit(width)))), "")


def blocks(nodes: DataFrame, group: list[str], name: str) -> DataFrame:
    """One row per 512 aligned nodes: ``block``, ``members`` (their rows in
    order), the level strings ``s0``.. (NULL where the tree ended below) and
    the block's ``top``."""
    payload = [c for c in nodes.columns if c not in (*group, "size")]
    gathered = (nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))
                .groupBy(*group, "size", "block")
                .agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in payload if c != "pos"]))).alias("members")))

    def levels(k: int, level: Column, held: list[Column]) -> Column:
        if k == LEVELS:
            return F.struct(*[s.alias(f"s{i}") for i, s in enumerate(held)], level.alias("top"))
        # level k has ceil(size / 8^k) nodes in the whole group; one node ends the tree
        more = F.col("size") > FANOUT ** k
        return _once(F.when(more, _parents(level)).otherwise(level),
                     lambda above: levels(k + 1, above, [*held, F.when(more, level)]))

    joined = F.array_join(F.transform("members", lambda m: m["node"]), "")
    out = gathered.withColumn("_l", _once(joined, lambda s: levels(0, s, [])))
    return stored(out.select(*group, "size", "block", "members", *[F.col(f"_l.s{k}").alias(f"s{k}") for k in range(LEVELS)],
                             F.col("_l.top").alias("top")), name)


def _flanks(level: Column, at: Column) -> Column:
    """(before, after) of node ``at`` (place in the block) within its run of 8
    in a level string; NULL where the level does not exist."""
    width = FANOUT * HEX
    run = F.floor(at / FANOUT).cast("int")
    own = (at % FANOUT).cast("int") * HEX
    return F.when(level.isNotNull(), _once(
        F.substring(level, run * width + 1, F.lit(width)),
        lambda s: F.struct(F.substring(s, F.lit(1), own).alias("before"),
                           F.substring(s, own + HEX + 1, F.lit(width)).alias("after"))))


def tree(nodes: DataFrame, group: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(proofs, roots) of the trees over ``nodes`` (group, size, pos, node and
    payload): each node's row with ``path``, its siblings level by level as
    (before, after), and one row per group with its ``root``."""
    held = blocks(nodes, group, name)
    rounds = held.agg(F.max("size").alias("n")).head()["n"] or 0
    tops = held.select(*group, F.ceil(F.col("size") / BLOCK).cast("long").alias("size"),
                       F.col("block").alias("pos"), F.col("top").alias("node"))
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    if rounds <= BLOCK:
        roots = held.select(*group, F.col("top").alias("root"))
        above = held.withColumn("_above", nothing)
    else:
        upper, roots = tree(tops, group, name)
        side = sized(upper.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)],
                                  F.col("pos").alias("_b"), F.col("path").alias("_above")))
        cond = F.col("block") == F.col("_b")
        for k, g in enumerate(group):
            cond = cond & F.col(g).eqNullSafe(F.col(f"_g{k}"))
        above = held.join(side, cond)
    # runs of 8 first: each takes its 512 characters once, members cut theirs out of those
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("members") - 1) / FANOUT).cast("int")), lambda r: F.struct(
        F.slice("members", r * FANOUT + 1, F.lit(FANOUT)).alias("eight"),
        F.substring("s0", r * (FANOUT * HEX) + 1, F.lit(FANOUT * HEX)).alias("run"),
        F.array(*[_flanks(F.col(f"s{k}"), F.floor(r / FANOUT ** (k - 1)).cast("int"))
                  for k in range(1, LEVELS)]).alias("more")))
    cut = above.select(*group, "_above", F.explode(runs).alias("_r")).select(
        *group, "_above", "_r.run", "_r.more", F.posexplode("_r.eight").alias("_k", "_m"))
    own = F.when(F.col("run").isNotNull(), F.struct(
        F.substring("run", F.lit(1), F.col("_k") * HEX).alias("before"),
        F.substring("run", (F.col("_k") + 1) * HEX + 1, F.lit(FANOUT * HEX)).alias("after")))
    path = F.concat(F.filter(F.concat(F.array(own), F.col("more")), lambda s: s.isNotNull()), F.col("_above"))
    return cut.select(*group, "_m.*", path.alias("path")), roots


def fold(path: Column, node: Column) -> Column:
    """The root that a node and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def siblings(path: Column) -> Column:
    """All siblings of a path, level by level, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, tampered: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """doc_id, leaf, ``presented`` (the leaf that ``tampered`` gives instead,
    where not NULL), subroot, root and path (siblings up to the root)."""
    mine = leaf(docs)
    other = tampered(docs) if tampered else F.lit(None).cast("string")
    hashed = stored(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"),
                                mine.alias("node"), other.alias("other")), "leaves")
    ranked = positions(hashed, ["lang"], ["doc_id", "node"], "ranked")
    inner, subroots = tree(ranked, ["lang"], "blocks")
    subroots = stored(subroots.withColumnRenamed("root", "node"), "subroots")
    outer, roots = tree(positions(subroots, [], ["lang"], "languages"), [], "top-blocks")
    top = sized(outer.select(F.col("lang").alias("_lang"), F.col("node").alias("subroot"), F.col("path").alias("_up"),
                             F.lit(1).alias("_one"))
                .join(F.broadcast(roots.withColumn("_one", F.lit(1))), "_one").drop("_one"))    # roots: one row at most
    return inner.join(top, F.col("lang").eqNullSafe(F.col("_lang"))).select(
        "doc_id", F.col("node").alias("leaf"), F.coalesce("other", "node").alias("presented"), "subroot", "root",
        F.concat("path", "_up").alias("path"))


def verify(rows: DataFrame) -> DataFrame:
    """Proof digest and check of the presented leaves of ``manifest``."""
    return (rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("path"))).alias("proof_sha256"),
                        fold(F.col("path"), F.col("presented")).alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
