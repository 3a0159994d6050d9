"""Operator 3: token ids in Simple-8b block files.

A 64-bit word holds a 4-bit selector and as many ids of one width as fit into
the other 60 bits; an id of more than 60 bits follows an escape word as it is.
A block is a row of the files: whole documents of some ``BLOCK_IDS`` ids, the
number of ids before it in its part, the place of each document in it, and
its words.  Parts follow each other in ascending doc_id order, so a
document's start is its part's offset, its block's and its own.

Defined results: a NULL text is empty and holds the end id alone; rows with a
NULL doc_id come first; repeated rows are written each, in text order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm import encoding
from tabvet.llm.common import body, scratch, stored
from tabvet.llm.token_counts import slices

BLOCK_IDS = 1 << 16
#: Offsets of up to this many parts (write tasks) are broadcast, joined by shuffle beyond.
BROADCAST_PARTS = 1_000_000

#: Ids per word and bits per id of each selector; selector 0 escapes one id
#: to the next word, selector 15 is a run of zeros.
COUNTS = np.array([1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 120], np.int64)
WIDTHS = np.array([64, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.uint8)
    v = v.astype(np.uint64)
    for step in (32, 16, 8, 4, 2, 1):
        big = v >= np.uint64(1) << np.uint64(step)
        out += big.astype(np.uint8) * np.uint8(step)
        v = np.where(big, v >> np.uint64(step), v)
    return out + (v > 0).astype(np.uint8)


def encode(ids: np.ndarray) -> np.ndarray:
    """The words of one stream of ids: at each place the selector that takes
    the most ids (the last word may be partly filled)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    bits = _bit_lengths(ids)
    best = np.zeros(n, np.uint8)
    # window[c]: the widest of the next c ids, from windows of fewer
    held, wide = 1, bits
    for s in range(1, 16):
        c, w = int(COUNTS[s]), int(WIDTHS[s])
        while held < c:
            step = min(held, c - held)
            wide = np.maximum(wide, np.concatenate([wide[step:], np.zeros(min(step, n), np.uint8)])[:n])
            held += step
        best[wide <= w] = s
    taken = COUNTS[best].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += taken[at]
    starts = np.array(starts, np.int64)
    selector = best[starts]
    words = selector.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids.astype(np.uint64), np.zeros(120, np.uint64)])
    for s in range(1, 15):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            first, width = starts[mine], np.uint64(WIDTHS[s])
            for k in range(int(COUNTS[s])):
                words[mine] |= padded[first + k] << (np.uint64(k) * width)
    escaped = np.flatnonzero(selector == 0)
    return np.insert(words, escaped + 1, ids[starts[escaped]].astype(np.uint64)) if len(escaped) else words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a stream, all words of one selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():               # the word after an escape is no selector
        plain, escape = np.ones(len(words), bool), np.zeros(len(words), bool)
        for k in np.flatnonzero(selector == 0).tolist():
            if plain[k]:
                escape[k], plain[k + 1] = True, False
        raw = words[np.flatnonzero(escape) + 1]
        words, selector = words[plain], selector[plain]
    else:
        raw = words[:0]
    counts = COUNTS[selector]
    place = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(selector == s)
        if len(mine):
            width = np.uint64(WIDTHS[s])
            mask = (np.uint64(1) << width) - np.uint64(1)
            for k in range(int(COUNTS[s])):
                out[place[mine] + k] = (words[mine] >> (np.uint64(k) * width)) & mask
    out[place[selector == 0]] = raw
    return out[:n]


_BLOCK = ("part int, block int, before long, n_ids long, doc_ids array<long>, offsets array<long>, words binary")


def _blocks(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Rows come in doc_id order; one row goes out per block."""
    encoder = encoding.load(tokenizer)
    part = TaskContext.get().partitionId()
    held: list[np.ndarray] = []
    docs: list[int | None] = []
    sizes: list[int] = []
    block = before = filled = 0

    def close():
        nonlocal block, before, filled
        ids = np.concatenate(held)
        row = {"part": part, "block": block, "before": before, "n_ids": filled, "doc_ids": list(docs),
               "offsets": (np.cumsum(sizes) - sizes).tolist(), "words": encode(ids).astype("<u8").tobytes()}
        block, before, filled = block + 1, before + filled, 0
        held.clear(), docs.clear(), sizes.clear()
        return pa.RecordBatch.from_pylist([row], _BLOCK_ARROW)

    for batch in batches:
        for first, rows in slices(batch.column("text")):
            ids, per = encoder.encode(batch.column("text").slice(first, rows), end_id)
            ends = np.cumsum(per)
            for doc, size, end in zip(batch.column("doc_id").slice(first, rows).to_pylist(), per.tolist(), ends.tolist()):
                held.append(ids[end - size:end])
                docs.append(doc)
                sizes.append(size)
                filled += size
                if filled >= BLOCK_IDS:
                    yield close()
    if docs:
        yield close()


_BLOCK_ARROW = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
                          ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
                          ("words", pa.binary())])


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Encode every text, end it with ``end_id`` and write the block files."""
    ordered = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(lambda it: _blocks(it, tokenizer, end_id), _BLOCK).write.parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = decode(np.frombuffer(row["words"], "<u8"), row["n_ids"]).astype("<u4")
            bounds = [*row["offsets"], row["n_ids"]]
            raw = ids.tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([row["part"]] * len(row["doc_ids"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                pa.array([row["before"] + o for o in row["offsets"]], pa.int64()),
                pa.array([raw[4 * a:4 * b] for a, b in zip(bounds, bounds[1:])], pa.binary())],
                names=["part", "doc_id", "within", "ids"])


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian
    unsigned 32-bit) of every document in the files."""
    blocks = spark.read.parquet(path)
    # one row per part; the running sum is over parts, not over documents
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = stored(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset")),
                   "token-parts")
    if parts.count() <= BROADCAST_PARTS:
        parts = F.broadcast(parts)
    found = blocks.mapInArrow(_documents, "part int, doc_id long, within long, ids binary")
    return found.join(parts, "part").select("doc_id", (F.col("offset") + F.col("within")).alias("start"), "ids")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    path = scratch(docs.sparkSession, "token-ids")
    write(docs, tokenizer, path, end_id)
    return read(docs.sparkSession, path)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.crc32("ids").alias("ids_crc32"))
