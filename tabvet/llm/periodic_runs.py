"""Operator 12: periodic runs by enumeration of maximal pairs.

A run is a stretch of consecutive words with smallest period q and at least
max(12, 2 q) words that neither neighbour extends with period q.  The words of
a text are ranked by prefix doubling into a suffix array (equal first words are
settled by the rank of what follows, suffixes already alone are left out), and
the common prefixes of neighbours in it come from the ranks of each doubling.
The tree of LCP intervals is then walked bottom-up.  Every interval holds its
positions in order, each with the class of its left word; where two children
meet, the shorter list is dealt into the longer one and positions that become
neighbours are maximal pairs if their left words are of different classes: the
next words differ already, as they come from different children.  A maximal
pair (i, j) with common prefix l and distance q = j - i <= l is the run of
q + l words from i: l cannot grow on either side, so nothing is extended.
Only neighbours can give a smallest period (an occurrence in between would
have a smaller one), so no pairs are listed beyond them; where a later child
comes between two neighbours, the smaller period of the same stretch wins.

A run has a pair of at least 6 common words (l = length - q is at least q, and
at least 12 - q), so only texts in which six words come twice are ranked and
only intervals of depth 6 or more are walked; and an interval whose closest
positions lie further apart than its longest common prefix has no run.

One row per row of the input, texts are taken whole and no rows are shuffled.  A
task holds the words of one stretch of texts (SLICE_BYTES, or one longer text)
and four bytes a word for each doubling.

Defined results: a NULL or empty text has no words and no runs; repeated rows
are worked on each; rows with a NULL doc_id are handled like others; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import body
from tabvet.llm.shingles import mix
from tabvet.llm.token_counts import slices

#: Least words of a run, and the common prefix that any run's pair has.
LEAST = 12
DEPTH = LEAST // 2
#: Text bytes worked on at a time (a longer text is worked on alone).
SLICE_BYTES = 4 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


def repeated(codes: np.ndarray, words: int) -> np.ndarray:
    """Places whose next ``words`` codes come elsewhere too (by 64-bit hashes:
    a few others may be among them)."""
    n = len(codes) - words + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    key = np.zeros(n, np.uint64)
    for k in range(words):
        key = mix(key ^ codes[k:k + n].astype(np.uint64), k)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    return order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]


def doubled(codes: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... codes: the number of
    suffixes that are smaller so far.  Equal ranks mean equal beginnings."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    first = np.concatenate([[True], codes[order][1:] != codes[order][:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    ranks, width = [rank], 1
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        after = open_ + width
        nxt = np.where(after < n, rank[np.minimum(after, n - 1)], -1).astype(np.int64)
        key = rank[open_].astype(np.int64) * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        at, key = open_[order], key[order]
        group = rank[at]
        new_group = np.concatenate([[True], group[1:] != group[:-1]])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        place = np.arange(len(at))
        starts = np.maximum.accumulate(np.where(new_group, place, 0))
        inner = np.maximum.accumulate(np.where(new_key, place, 0))
        rank = rank.copy()
        rank[at] = group + (inner - starts).astype(np.int32)
        ranks.append(rank)
        width *= 2
        alone = new_key & np.concatenate([new_key[1:], [True]])
        open_ = np.sort(at[~alone])
    return ranks


def common(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common codes at the beginning of the suffixes a and b, pair by pair."""
    n = len(ranks[0])
    out = np.zeros(len(a), np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        x, y = a + out, b + out
        inside = (x < n) & (y < n)
        same = inside & (rank[np.minimum(x, n - 1)] == rank[np.minimum(y, n - 1)])
        out += same.astype(np.int64) << level
    return out


def walk(places: list[int], lcp: list[int], left: list[int], found: dict[tuple[int, int], int]) -> None:
    """Bottom-up over the LCP intervals of one stretch of the suffix array;
    ``lcp[k]`` is between places k - 1 and k.  ``found``: (start, length) ->
    period."""
    def meet(i: int, j: int, depth: int) -> None:
        q = j - i
        if q <= depth and q + depth >= LEAST and left[i] != left[j]:
            stretch = (i, q + depth)
            if found.get(stretch, q) >= q:
                found[stretch] = q

    def join(a: list[int], b: list[int], depth: int) -> list[int]:
        if len(a) < len(b):
            a, b = b, a
        last = -1
        for p in b:
            k = bisect_left(a, p)
            if k and a[k - 1] != last:                 # not from the same child
                meet(a[k - 1], p, depth)
            if k < len(a):
                meet(p, a[k], depth)
            a.insert(k, p)
            last = p
        return a

    depths: list[int] = []
    held: list[list[int]] = []
    own = [places[0]]
    for k in range(1, len(places) + 1):
        depth = lcp[k] if k < len(places) else 0
        while depths and depths[-1] > depth:
            own = join(held.pop(), own, depths.pop())
        if k == len(places):
            break
        if depths and depths[-1] == depth:
            held[-1] = join(held[-1], own, depth)
        else:
            depths.append(depth)
            held.append(own)
        own = [places[k]]


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; codes that occur once end texts."""
    n = len(codes)
    ranks = doubled(codes)
    suffixes = np.empty(n, np.int64)
    suffixes[ranks[-1]] = np.arange(n)
    deep = ranks[min(2, len(ranks) - 1)]                # first four codes
    near = np.flatnonzero(deep[suffixes[1:]] == deep[suffixes[:-1]])
    lcp = np.zeros(n + 1, np.int64)
    lcp[near + 1] = common(ranks, suffixes[near], suffixes[near + 1])
    joined = lcp >= DEPTH
    # stretches of the suffix array whose neighbours share DEPTH codes
    member = np.flatnonzero(joined[:-1] | joined[1:])
    if not len(member):
        return []
    head = ~joined[member]
    group = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    sizes = np.diff(np.append(starts, len(member)))
    place, depth = suffixes[member], np.where(head, 0, lcp[member])
    # the closest two positions of a stretch against its longest common prefix
    order = np.lexsort((place, group))
    gap = np.full(len(member), n + 1, np.int64)
    gap[1:] = np.where(group[order][1:] == group[order][:-1], place[order][1:] - place[order][:-1], n + 1)
    hopeful = np.minimum.reduceat(gap, starts) <= np.maximum.reduceat(depth, starts)
    left = np.concatenate([[-1], codes[:-1]])
    found: dict[tuple[int, int], int] = {}
    # an interval of two positions has nothing to merge
    two = starts[hopeful & (sizes == 2)]
    i, j, d = np.minimum(place[two], place[two + 1]), np.maximum(place[two], place[two + 1]), depth[two + 1]
    q = j - i
    good = (q <= d) & (q + d >= LEAST) & (left[i] != left[j])
    found.update(zip(zip(i[good].tolist(), (q + d)[good].tolist()), q[good].tolist()))
    lefts = left.tolist() if (hopeful & (sizes > 2)).any() else []
    for k in np.flatnonzero(hopeful & (sizes > 2)).tolist():
        part = slice(starts[k], starts[k] + sizes[k])
        walk(place[part].tolist(), depth[part].tolist(), lefts, found)
    return sorted((s, ln, q) for (s, ln), q in found.items())


def _texts(texts: list[bytes]) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs of each text."""
    words = [t.split() for t in texts]                  # bytes split at the six blanks
    codes, firsts, base = [], [0], 0
    for w in words:
        ids = {x: k for k, x in enumerate(dict.fromkeys(w), base)}
        codes.append(np.fromiter(map(ids.__getitem__, w), np.int64, len(w)))
        base += len(ids) + 1
        codes.append(np.array([base - 1]))               # ends the text, occurs once
        firsts.append(firsts[-1] + len(w) + 1)
    flat = np.concatenate(codes) if codes else np.zeros(0, np.int64)
    bounds = np.array(firsts)
    suspects = np.unique(np.searchsorted(bounds, repeated(flat, DEPTH), "right") - 1)
    per: dict[int, list[tuple[int, int, int]]] = {}
    if len(suspects):
        parts = [flat[bounds[k]:bounds[k + 1]] for k in suspects]
        ends = np.cumsum([0, *map(len, parts)])
        _, dense = np.unique(np.concatenate(parts), return_inverse=True)
        for s, ln, q in runs_of(dense):
            k = int(np.searchsorted(ends, s, "right")) - 1
            per.setdefault(int(suspects[k]), []).append((s - int(ends[k]), ln, q))
    for k, w in enumerate(words):
        yield w, per.get(k, [])


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run has after its first period."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, ln, q in runs:
        edge[s + q] += 1
        edge[s + ln] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist()) if k])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        for first, n in slices(batch.column("text"), SLICE_BYTES):
            texts = batch.column("text").slice(first, n).cast(pa.large_binary()).to_pylist()
            counts, lists, rest = [], [0], []
            flat: list[tuple[int, int, int]] = []
            for words, runs in _texts(texts):
                counts.append(len(words))
                flat += runs
                lists.append(len(flat))
                rest.append(collapsed(words, runs))
            cols = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").slice(first, n), pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(np.array(lists, np.int32), pa.StructArray.from_arrays(cols, fields=list(pairs))),
                pc.cast(pa.array(rest, pa.binary()), pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, ``runs`` by start and period, and ``collapsed``: the
    text with one period of every run, joined by single blanks."""
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text"))
            .mapInArrow(_rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth text (by the crc32 of its decimal
    doc_id) goes on periodically from a word that the same value picks."""
    doc_id = docs["doc_id"].cast("long")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (F.floor((n - a) / (F.lit(3) + g % 8)) + 1).cast("int")
        unit = F.array_join(F.slice(words, a + 1, p), " ")
        whole = F.floor((n - a) / p).cast("int")
        rest = (n - a) - whole * p
        text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.array_repeat(unit, whole),
                                     F.slice(words, a + 1, rest)), " ")
        return F.when(n > 0, text)

    words = F.filter(F.split(body(docs), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    changed = F.element_at(F.transform(F.array(words), periodic), 1)
    return docs.select(doc_id.alias("doc_id"),
                       F.when(h % 10 == 0, F.coalesce(changed, F.lit(""))).otherwise(body(docs)).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """One row per text: its runs counted, the longest one, and digests."""
    best = F.element_at(F.array_sort(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    some = F.size("runs") > 0
    held = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"),
                        F.when(some, best).alias("best"),
                        F.sha2(F.when(some, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("best.l"), F.col("best.p")
    return held.select("doc_id", "n_words", "n_runs", F.col("best.s").alias("start"), length.alias("length"),
                       period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
