"""Operator 4: near-duplicates by BagMinHash over multisets of word shingles.

A text is the multiset of its five-word shingles (words are separated by
blanks; a text of one to four words is one shingle).  Signatures come from
Poisson processes over discretised weights: the levels 1, 2, 3, ... of a
shingle's count are covered by blocks [2^j, 2^(j+1)), each with its own
process of rate 2^j; a block that the count fills only in part is split in
halves down to it, so every level carries the same unit rate for each text
that has it.  A point is (time, component), and the earliest point of each
component is the signature: two texts agree in a component with the
probability of their weighted Jaccard similarity.

Texts with the same multiset are one class from the start.  Signatures are
banded; in each bucket every member is compared with one pivot, the member
that meets the most others, by exact multiset overlap.  Members that do not
reach the threshold but are near the pivot are then compared with the pivot's
other members in tiles of at most 2 x TILE texts, so a link that does not go
through a pivot is found too and no bucket is expanded into pairs.  Members
far from the pivot meet, in tiles again, those of their bucket that can still
be linked with one of them (by the triangle inequality these are under NEAR +
1 - threshold to the pivot): every two texts over the threshold that share a
bucket end in one class.
Classes are the connected components of the links found; the smallest doc_id
names the class and stays.

A multiset is a node of its own, whatever ids its texts have; a text is known
by its doc_id and a 64-bit hash of its characters.

Defined results: a NULL or empty text (no words) is a class of its own, kept;
rows with a NULL doc_id are left alone (a class of their own, kept); repeated
rows are one class, all marked as kept, and ``keep`` retains one of them.
Different texts under one doc_id are documents of their own: each belongs to
the class of its words, and is kept or dropped by itself.  A class is named by
the smallest doc_id among its texts (two classes have the same name where that
id has different texts) and keeps that id's text; of several texts of the id in
one class, the one of the smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import body, column_names, stored
from tabvet.llm.components import components
from tabvet.llm.shingles import elements, mix, occurrences, overlap, shingles
from tabvet.llm.token_counts import slices
from tabvet.session import sized

WORDS = 5
THRESHOLD = 0.8
#: 26 bands of 5: a pair at similarity 0.8 shares a band but for 3 in 100,000.
BANDS, ROWS = 26, 5
#: Members at least this near to their pivot are compared among themselves.
NEAR = 0.4
TILE = 128


def signatures(hashes: np.ndarray, text: np.ndarray, counts: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """BagMinHash signatures (n_texts x size times) of weighted sets given as
    (text, hash, count) with integer counts."""
    # processes: one per (text, shingle, block of levels) that the count reaches
    owner, seed, rate, within = [], [], [], []
    block, live = 0, np.arange(len(hashes))
    while len(live):
        first = 1 << block
        owner.append(text[live])
        seed.append(mix(hashes[live], 1000 + block))
        rate.append(np.full(len(live), first, np.int64))
        within.append(np.minimum(counts[live] - first + 1, first))        # its levels that the count has
        live = live[counts[live] >= 2 * first]
        block += 1
    times = np.full(n_texts * size, np.inf)
    if not owner:
        return times.reshape(n_texts, size)
    owner, seed, rate, within = (np.concatenate(x) for x in (owner, seed, rate, within))
    clock = np.zeros(len(owner))
    nth = 0
    while len(owner):
        draw = mix(seed, 3 * nth)
        clock = clock - np.log((draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53 + 2.0 ** -54) / rate
        other = mix(seed, 3 * nth + 1)
        place = owner * size + ((other >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        # halving a block bit by bit gives the point's level in it
        counted = (other & np.uint64(0xFFFFFFFF)).astype(np.int64) % rate < within
        earlier = counted & (clock < times[place])
        np.minimum.at(times, place[earlier], clock[earlier])
        here = np.unique(owner)
        latest = np.full(n_texts, -1.0)
        latest[here] = times.reshape(n_texts, size)[here].max(1)
        go = clock < latest[owner]
        owner, seed, rate, within, clock = owner[go], seed[go], rate[go], within[go], clock[go]
        nth += 1
    return times.reshape(n_texts, size)


def band_keys(times: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit key of each band of each signature."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(times), bands)).copy()
    for r in range(rows):
        key = mix(key ^ bits[:, :, r], r)
    return key


def _sign(batches: Iterator[pa.RecordBatch], words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n in slices(batch.column("text"), 4 << 20):
            hashes, per = shingles(batch.column("text").slice(first, n), words)
            text = np.repeat(np.arange(n), per)
            # wrapping sums over all shingles name the multiset
            ends = np.concatenate([[0], np.cumsum(per)])
            names = []
            for salt in (7, 8):
                run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes, salt))])
                names.append((run[ends[1:]] - run[ends[:-1]]).view(np.int64))
            keys = band_keys(signatures(*_weighted(hashes, text), n, bands * rows), bands, rows).view(np.int64)
            some = per > 0
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, n), batch.column("mark").slice(first, n), pa.array(per),
                pa.array(names[0]), pa.array(names[1]),
                pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(some, bands, 0))]).astype(np.int32),
                                         keys[some].ravel())],
                names=["doc_id", "mark", "n_shingles", "name1", "name2", "keys"])


def _weighted(hashes, text):
    t, h, c = occurrences(hashes, text)
    return h, t, c


def signed(docs: DataFrame, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, mark (hash of the text), n_shingles, a 128-bit name of the
    multiset and the band keys."""
    return _plain(docs).mapInArrow(lambda it: _sign(it, words, bands, rows),
                                   "doc_id long, mark long, n_shingles long, name1 long, name2 long, keys array<long>")


def _plain(docs: DataFrame) -> DataFrame:
    text = body(docs)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _compare(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Rows come in (pivot, page, member) order, the pivot's own text first
    (member False); holds that one text."""
    pivot, base = None, None
    for batch in batches:
        out = []
        for p, member, doc, text in zip(*(batch.column(c).to_pylist() for c in ("pivot", "member", "doc", "text"))):
            if not member:
                pivot, base = p, elements(text, words)
            elif p == pivot:
                out.append((p, doc, overlap(base, elements(text, words))))
        p, d, s = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.float64())],
                                         names=["pivot", "doc", "similarity"])


def tile_links(sets: list[np.ndarray], linked: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links of a tile that join different parts; ``linked`` members are one
    part already."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, who = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    who, column = who[shared], column[shared]
    both = np.zeros((n, n), np.float32)
    at, width = 0, 4096
    if len(column):
        column = np.cumsum(np.concatenate([[0], (np.diff(column) > 0).astype(np.int64)]))
        while at <= column[-1]:
            lo, hi = np.searchsorted(column, [at, at + width])
            part = np.zeros((n, width), np.float32)
            part[who[lo:hi], column[lo:hi] - at] = 1
            both += part @ part.T
            at += width
    total = sizes[:, None] + sizes[None, :] - both
    near = np.triu(both >= threshold * total, 1) & (total > 0)
    near &= ~(linked[:, None] & linked[None, :])
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first = -1
    for k in np.flatnonzero(linked).tolist():
        if first < 0:
            first = k
        root[k] = first
    out = []
    for i, j in zip(*np.nonzero(near)):
        a, b = find(int(i)), find(int(j))
        if a != b:
            root[b] = a
            out.append((int(i), int(j)))
    return out


def _tiles(batches: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows come in tile order; holds the texts of one tile."""
    tile, held = None, []

    def close():
        docs, linked, texts = zip(*held)
        found = tile_links([elements(t, words) for t in texts], np.array(linked), threshold)
        return pa.RecordBatch.from_arrays([pa.array([docs[i] for i, _ in found], pa.int64()),
                                           pa.array([docs[j] for _, j in found], pa.int64())], names=["a", "b"])

    for batch in batches:
        for p, i, j, doc, linked, text in zip(*(batch.column(c).to_pylist()
                                                for c in ("pivot", "i", "j", "doc", "linked", "text"))):
            if tile != (p, i, j):
                if held:
                    yield close()
                tile, held = (p, i, j), []
            held.append((doc, linked, text))
    if held:
        yield close()


def links(reps: DataFrame, docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD,
          near: float = NEAR, tile: int = TILE) -> DataFrame:
    """Links (a, b) between multisets at ``threshold`` or more; ``reps``: node,
    doc_id, mark and keys of one text of each multiset."""
    banded = reps.select(F.col("node").alias("doc"), F.explode("keys").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    meets = stored(banded.join(shared, "bucket").select("bucket", "doc", "n"), "buckets")
    members = meets.select("doc").distinct()
    wanted = stored(reps.select(F.col("node").alias("doc"), "doc_id", "mark").join(members, "doc", "left_semi"), "wanted")
    small = wanted.count() <= BROADCAST_IDS
    # equal rows have equal texts: any of them serves
    texts = stored(_plain(docs).join(F.broadcast(wanted) if small else wanted, ["doc_id", "mark"])
                   .select("doc", "text").dropDuplicates(["doc"]), "near-texts")
    # the pivot of a bucket meets the most others over all its buckets
    centre = meets.groupBy("doc").agg(F.sum("n").alias("meets"))
    pivots = stored(meets.join(centre, "doc").groupBy("bucket")
                    .agg(F.max(F.struct("meets", (-F.col("doc")).alias("d"))).alias("p"))
                    .select("bucket", (-F.col("p.d")).alias("pivot")), "pivots")
    dealt = meets.select("bucket", "doc").join(pivots, "bucket").filter("doc <> pivot")
    measured = _measured(stored(dealt.select("pivot", "doc").distinct(), "pairs"), texts, words, tile)
    straight = measured.filter(F.col("similarity") >= threshold).select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    found = straight.unionByName(_crossed(measured, texts, words, threshold, near, tile))
    # what is far from its pivot meets those of its bucket that may be linked to it
    far = F.col("similarity") < near
    if measured.filter(far).isEmpty():
        return found
    rest = sized(measured.filter(F.col("similarity") < near + 1 - threshold).select("pivot", "doc", far.alias("far")))
    left = stored(dealt.join(rest, ["pivot", "doc"]).select("bucket", "doc", "far"), "left")
    again = left.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).filter("far AND n > 1")
    unlinked = left.join(again.select("bucket"), "bucket").select(
        F.col("bucket").alias("pivot"), "doc", F.lit(float(near)).alias("similarity"))
    return found.unionByName(_crossed(unlinked, texts, words, threshold, near, tile))


def _measured(pairs: DataFrame, texts: DataFrame, words: int, tile: int) -> DataFrame:
    """pivot, doc and similarity of all pairs; a pivot's members are dealt to
    pages of some 2 x ``tile``."""
    paged = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / (2 * tile)).cast("int").alias("pages"))
    paged = stored(paged, "pages")
    # a pivot of one page needs no look-up, so a hot one is not dealt by its key
    wide = sized(paged.filter("pages > 1"))
    members = (pairs.join(wide, "pivot", "left").join(texts, "doc")
               .select("pivot", F.pmod(F.xxhash64("doc"), F.coalesce("pages", F.lit(1))).cast("int").alias("page"),
                       F.lit(True).alias("member"), "doc", "text"))
    heads = (paged.join(texts.withColumnRenamed("doc", "pivot"), "pivot")
             .select("pivot", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)).alias("page"),
                     F.lit(False).alias("member"), F.col("pivot").alias("doc"), "text"))
    return stored(members.unionByName(heads).repartition("pivot", "page")
                  .sortWithinPartitions("pivot", "page", "member", "doc")
                  .mapInArrow(lambda it: _compare(it, words), "pivot long, doc long, similarity double"), "measured")


def _crossed(measured: DataFrame, texts: DataFrame, words: int, threshold: float, near: float, tile: int) -> DataFrame:
    """Links (a, b) of members near a pivot that it does not link, with its
    other members."""
    linked = F.col("similarity") >= threshold
    sizes = sized(measured.filter(F.col("similarity") >= near).groupBy("pivot")
                  .agg(F.sum(F.when(linked, 0).otherwise(1)).alias("loose"),
                       F.sum(F.when(linked, 1).otherwise(0)).alias("tight"))
                  .filter("loose > 0 AND loose + tight > 1")
                  .select("pivot", F.ceil(F.col("loose") / tile).cast("int").alias("pu"),
                          F.ceil(F.col("tight") / tile).cast("int").alias("pl")))
    around = (measured.filter(F.col("similarity") >= near).join(sizes, "pivot")
              .select("pivot", "doc", linked.alias("linked"), "pu", "pl",
                      F.when(linked, F.col("pu") + F.pmod(F.xxhash64("doc"), F.greatest("pl", F.lit(1))))
                      .otherwise(F.pmod(F.xxhash64("doc"), F.col("pu"))).cast("int").alias("page")))
    # every pair of pages that has a loose one meets in one tile
    other = F.explode(F.when(F.col("linked"), F.sequence(F.lit(0), F.col("pu") - 1))
                      .otherwise(F.sequence(F.lit(0), F.col("pu") + F.col("pl") - 1)))
    tiled = (around.withColumn("other", other)
             .select("pivot", F.least("page", "other").alias("i"), F.greatest("page", "other").alias("j"), "doc", "linked"))
    crossed = (tiled.join(texts, "doc").repartition("pivot", "i", "j")
               .sortWithinPartitions("pivot", "i", "j", "doc")
               .mapInArrow(lambda it: _tiles(it, words, threshold), "a long, b long"))
    return stored(crossed, "crossed")


#: Keys of bucketed or dropped texts are broadcast up to this many (24 bytes each), joined by shuffle beyond.
BROADCAST_IDS = 1_000_000


def classes(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its
    near-duplicates), kept (it is that id's text)."""
    return _classified(docs, words, threshold).drop("mark")


def _classified(docs: DataFrame, words: int, threshold: float) -> DataFrame:
    rows = stored(signed(docs, words), "signed")
    known = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    first = known.groupBy("name1", "name2").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    same = stored(first.select("name1", "name2", "first.doc_id", "first.mark",
                               F.monotonically_increasing_id().alias("node")), "multisets")
    reps = stored(known.join(same, ["name1", "name2", "doc_id", "mark"]).select("node", "doc_id", "mark", "keys")
                  .dropDuplicates(["node"]), "representatives")
    found = components(links(reps, docs, words, threshold))
    placed = same.join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = placed.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("head"))
    named = placed.join(heads, "label").select("name1", "name2", "head")
    out = known.select("doc_id", "mark", "name1", "name2").join(named, ["name1", "name2"]).select(
        "doc_id", "mark", F.col("head.doc_id").alias("class_id"),
        ((F.col("doc_id") == F.col("head.doc_id")) & (F.col("mark") == F.col("head.mark"))).alias("kept"))
    alone = rows.filter("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "mark", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def keep(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that their class keeps, repeated ones once; rows
    without an id all stay."""
    found = stored(_classified(docs, words, threshold), "classes")
    gone = stored(found.filter("NOT kept").select("doc_id", "mark").distinct(), "gone")
    doc, mark = column_names(docs, "_gone", "_mark")
    gone = gone.select(F.col("doc_id").alias(doc), F.col("mark").alias(mark))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    left = docs.join(gone, (docs["doc_id"] == F.col(doc)) & (F.xxhash64(body(docs)) == F.col(mark)), "left_anti")
    again = found.filter("kept AND doc_id IS NOT NULL").groupBy("doc_id", "mark").count().filter("count > 1")
    if again.isEmpty():
        return left
    known = left.filter("doc_id IS NOT NULL").withColumn(mark, F.xxhash64(body(docs)))
    return left.filter("doc_id IS NULL").unionByName(known.dropDuplicates(["doc_id", mark]).drop(mark))
