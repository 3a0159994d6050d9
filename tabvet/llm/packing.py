"""Operator 7: packing by powers of two.

A document of n ids falls into pieces of the powers of two that make up n
(``longest`` as often as it fits, then the binary digits of the rest, longest
first), and each piece is a sequence of its own: equal lengths share a bucket,
no sequence crosses documents, and none is padded.

Defined results: a NULL text is empty and is packed as its end id; repeated
rows are packed each; an empty table packs to no sequence.
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

LONGEST = 2048
#: Text bytes encoded and cut at a time (a longer text is worked on alone).
SLICE_BYTES = 2 << 20
#: First numbers of up to this many (bucket, task) pairs are broadcast (20 bytes each), joined by shuffle beyond.
BROADCAST_PARTS = 1_000_000

_PIECES = "part int, doc_id long, start long, length long, doc_tokens long, nth long, ids binary"


def cut(sizes: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these sizes,
    in document order, longer pieces first.  ``longest`` is a power of two."""
    whole = sizes // longest
    digits = 1 << np.arange(longest.bit_length() - 2, -1, -1)
    has = (sizes[:, None] & digits[None, :]) > 0
    per = whole + has.sum(1)
    doc = np.repeat(np.arange(len(sizes)), per)
    ends = np.cumsum(per)
    rank = np.arange(len(doc)) - np.repeat(ends - per, per)
    length = np.full(len(doc), longest, np.int64)
    row, col = np.nonzero(has)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(has.sum(1)) - has.sum(1), has.sum(1))
    length[(ends - per + whole)[row] + nth] = digits[col]
    total = np.cumsum(length)
    start = total - length
    first = np.flatnonzero(rank == 0)
    start = start - np.repeat(start[first], per[per > 0])
    return doc, start, length


def _pieces(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, longest: int) -> Iterator[pa.RecordBatch]:
    encoder = encoding.load(tokenizer)
    part = TaskContext.get().partitionId()
    seen = np.zeros(longest.bit_length(), np.int64)          # pieces so far per bucket
    for batch in batches:
        for first, rows in slices(batch.column("text"), SLICE_BYTES):
            ids, per = encoder.encode(batch.column("text").slice(first, rows), end_id)
            doc, start, length = cut(per, longest)
            at = (np.cumsum(per) - per)[doc] + start
            raw = ids.astype("<u4").tobytes()
            bucket = np.log2(length).astype(np.int64)
            nth = np.zeros(len(bucket), np.int64)
            for b in np.unique(bucket):
                mine = bucket == b
                n = int(mine.sum())
                nth[mine] = seen[b] + np.arange(n)
                seen[b] += n
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(doc), part, np.int32)),
                batch.column("doc_id").slice(first, rows).take(pa.array(doc)),
                pa.array(start), pa.array(length), pa.array(per[doc]), pa.array(nth),
                pa.array([raw[4 * a:4 * (a + n)] for a, n in zip(at.tolist(), length.tolist())], pa.binary())],
                names=["part", "doc_id", "start", "length", "doc_tokens", "nth", "ids"])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST) -> DataFrame:
    """One row per piece, which is a whole sequence: doc_id, start, length,
    doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit).

    Sequences are numbered without gaps, longest bucket first.
    """
    spark = docs.sparkSession
    path = scratch(spark, "packed")
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text"))
    (plain.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, longest), _PIECES)
     .write.option("compression", "zstd").parquet(path))
    pieces = spark.read.parquet(path)
    # a row per (bucket, part); parts are tasks, not documents
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    buckets = counts.groupBy("length").agg(F.sum("n").alias("all"))
    buckets = buckets.select("length", (F.sum("all").over(Window.orderBy(F.col("length").desc()))
                                        - F.col("all")).alias("base"))
    parts = counts.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part"))
                                             - F.col("n")).alias("offset"))
    offsets = stored(parts.join(buckets, "length")
                     .select("length", "part", (F.col("base") + F.col("offset")).alias("first")), "packed-offsets")
    if offsets.count() <= BROADCAST_PARTS:
        offsets = F.broadcast(offsets)
    return pieces.join(offsets, ["length", "part"]).select(
        "doc_id", "start", "length", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), "ids")


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")
