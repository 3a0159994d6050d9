"""Operator 6: exact dedup by an extendible-hash index on shared files.

Texts are equal when their bytes are, blanks deleted.  The index key is the
leading 64 bits of the SHA-256 of the squeezed text.  A directory over the
leading key bits is doubled while a bucket is overfull, so that every bucket
(a key range) fits its owner task; a key that alone overfills its bucket is
chained over pages.  Owner tasks stream their range in order, chain the
different texts of one key, compare bytes, and write (row -> winner) entries
to the index files.  The winners of a paged key go through the same owners
again, one round per factor of ``page_rows``, until one page holds them all.

Of equal texts the row with the most code points stays, then the smallest
doc_id (NULL last), then the first in the table.

Defined results: a NULL text is the empty text; a NULL doc_id is an id of its
own; rows that repeat text and doc_id count one by one and one of them stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.llm.common import BLANKS, column_names, stored

#: The directory has at most 2^MAX_DEPTH entries, whatever the table's size.
MAX_DEPTH = 14
#: A paged key holds at least 1 / MAX_PAGED_KEYS of all rows, so there are at most that many.
MAX_PAGED_KEYS = 8192
PAGE_ROWS = 256
BUCKET_ROWS = 64

_DELETE = BLANKS.encode()


def squeezed(text: bytes | None) -> bytes:
    return (text or b"").translate(None, _DELETE)


def double_directory(prefix_rows: dict[int, int], depth: int, capacity: int) -> list[int]:
    """Extendible hashing over row counts per prefix of ``depth`` bits: one
    bucket at first; an overfull bucket splits in two (which doubles the
    directory when its local depth passes the global one) while it spans more
    than one prefix.  Returns the bucket number of each prefix."""
    rows = [prefix_rows.get(p, 0) for p in range(1 << depth)]
    directory = [0] * (1 << depth)
    todo, buckets = [(0, 0, 0)], 1          # bucket, its local depth, its first prefix
    while todo:
        bucket, local, first = todo.pop()
        width = 1 << (depth - local)
        if width == 1 or sum(rows[first:first + width]) <= capacity:
            continue
        half = width // 2
        directory[first + half:first + width] = [buckets] * half
        todo += [(bucket, local + 1, first), (buckets, local + 1, first + half)]
        buckets += 1
    return directory


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds key and digest to (.., text) rows."""
    for batch in batches:
        digests = [hashlib.sha256(squeezed(t)).digest()
                   for t in batch.column("text").cast(pa.binary()).to_pylist()]
        keys = pa.array([int.from_bytes(d[:8], "big", signed=True) for d in digests], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, keys, pa.array(digests, pa.binary())],
                                         names=[*batch.schema.names, "key", "digest"])


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in (key, page, preference) order; holds one chain: the first
    row of each different text of the (key, page)."""
    last, chain = None, []
    for batch in batches:
        names = batch.schema.names
        key, page, ids = (batch.column(c).to_pylist() for c in ("key", "page", "row_id"))
        texts = batch.column("text").cast(pa.binary())
        winners = []
        for i in range(batch.num_rows):
            if last != (key[i], page[i]):
                last, chain = (key[i], page[i]), []
            text = squeezed(texts[i].as_py())
            at = next((row for row, other in chain if other == text), None)
            if at is None:
                at = ids[i]
                chain.append((at, text))
            winners.append(at)
        won = pa.array([w == r for w, r in zip(winners, ids)], pa.bool_())
        cols = {c: batch.column(c) for c in names if c != "page"}
        for c in ("text", "rest"):          # losers go on as entries only
            if c in cols:
                cols[c] = cols[c].filter(won).take(pa.array(_places(won), pa.int32()))
        cols |= {"winner": pa.array(winners, pa.int64()), "won": won}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _places(won: pa.Array) -> list[int | None]:
    out, n = [], 0
    for w in won.to_pylist():
        out.append(n if w else None)
        n += w
    return out


def _owners(rows: DataFrame) -> DataFrame:
    """One pass of the owner tasks over (bucket, key, page) ranges."""
    ordered = (rows.repartition("bucket", "page")
               .sortWithinPartitions("bucket", "key", "page", F.col("n_chars").desc(),
                                     F.col("doc_id").asc_nulls_last(), "row_id").drop("bucket"))
    # losers have neither text nor rest, so every field may be null
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in ordered.schema if f.name != "page"]
                          + [T.StructField("winner", T.LongType()), T.StructField("won", T.BooleanType())])
    return ordered.mapInArrow(_owner, schema)


def _with_pages(rows: DataFrame, counts: DataFrame, total: int, page_rows: int) -> tuple[DataFrame, bool]:
    """Adds page (0 but for the overfull keys, at most MAX_PAGED_KEYS) and
    paged; says whether there is any paged key."""
    big = (counts.filter((F.col("n") > page_rows) & (F.col("n") * MAX_PAGED_KEYS >= F.lit(total)))
           .select(F.col("key").alias("_key"), F.ceil(F.col("n") / page_rows).alias("_pages")))
    held = [(r["_key"], int(r["_pages"])) for r in big.collect()]          # bounded: MAX_PAGED_KEYS rows
    spark = rows.sparkSession
    if not held:
        return rows.withColumn("page", F.lit(0)).withColumn("paged", F.lit(False)), False
    small = spark.createDataFrame(held, "_key long, _pages long")
    out = (rows.join(F.broadcast(small), rows["key"] == small["_key"], "left")
           .withColumn("page", F.coalesce(F.pmod(F.xxhash64("row_id"), F.col("_pages")), F.lit(0)).cast("int"))
           .withColumn("paged", F.col("_pages").isNotNull()).drop("_key", "_pages"))
    return out, True


def _bucketed(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Adds the bucket that the directory gives for the key's prefix."""
    capacity = max(BUCKET_ROWS, total >> (MAX_DEPTH - 1))
    depth = min(MAX_DEPTH, max(1, (4 * total // capacity).bit_length()))

    def prefix(key: Column) -> Column:
        return F.shiftrightunsigned(key, 64 - depth).cast("int")

    found = counts.groupBy(prefix(F.col("key")).alias("p")).agg(
        F.sum(F.least("n", F.lit(capacity))).alias("n")).collect()        # at most 2^MAX_DEPTH rows
    directory = double_directory({r["p"]: int(r["n"]) for r in found}, depth, capacity)
    entries = rows.sparkSession.createDataFrame(list(enumerate(directory)), "_prefix int, bucket int")
    return rows.join(F.broadcast(entries), prefix(rows["key"]) == entries["_prefix"]).drop("_prefix")


def build(docs: DataFrame, with_rows: bool = False, page_rows: int = PAGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """The index files of ``docs``: (entries, lost).

    entries, one per row: row_id, doc_id, n_chars, digest, key, paged, winner
    (row_id that stays within the row's page), won, text (of winners; without
    ``with_rows`` only of paged keys) and, with ``with_rows``, rest (the other
    columns of winners).  lost: (row_id, final) of page winners that a later
    round put behind another row.
    """
    rest = [c for c in docs.columns if c not in ("text", "doc_id")]
    (pad,) = column_names(docs, "_pad")
    cols = [F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].cast("long").alias("doc_id"),
            F.length(F.coalesce(docs["text"], F.lit(""))).alias("n_chars"), docs["text"]]
    if with_rows:
        cols.append(F.struct(F.lit(None).cast("int").alias(pad), *[docs[f"`{c}`"] for c in rest]).alias("rest"))

    def keyed(df: DataFrame) -> DataFrame:
        return df.mapInArrow(_keyed, T.StructType([*df.schema, T.StructField("key", T.LongType()),
                                                   T.StructField("digest", T.BinaryType())]))

    counts = stored(keyed(docs.select("text")).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "dedup-keys")
    total = int(counts.agg(F.sum("n")).head()[0] or 0)
    rows, paged = _with_pages(_bucketed(keyed(docs.select(*cols)), counts, total), counts, total, page_rows)
    entries = _owners(rows)
    if not with_rows:
        entries = entries.withColumn("text", F.when(F.col("paged"), F.col("text")))
    entries = stored(entries, "dedup-index")

    spark = docs.sparkSession
    lost = spark.createDataFrame([], "row_id long, final long")
    level = entries.filter("paged and won").select("row_id", "doc_id", "n_chars", "text", "key")
    while paged:
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        up, paged = _with_pages(level, sizes, 0, page_rows)
        up = stored(_owners(up.withColumn("bucket", F.col("key"))), "dedup-pages")
        now = up.filter("not won").select("row_id", F.col("winner").alias("final"))
        # earlier losers follow their winner when it loses in turn
        ahead = now.select(F.col("row_id").alias("final"), F.col("final").alias("_next"))
        lost = stored(lost.join(ahead, "final", "left")
                      .select("row_id", F.coalesce("_next", "final").alias("final")).unionByName(now), "dedup-lost")
        level = up.filter("won").select("row_id", "doc_id", "n_chars", "text", "key")
    return entries, lost


def groups(docs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id (doc_id of the row that
    stays), group_size, kept, text_sha256 (hex)."""
    entries, lost = build(docs, page_rows=page_rows)
    # page winners carry the sums, so a huge group is joined page by page
    pages = (entries.groupBy("winner").agg(F.count(F.lit(1)).alias("n"))
             .join(lost.withColumnRenamed("row_id", "winner"), "winner", "left")
             .select("winner", "n", F.coalesce("final", "winner").alias("final")))
    sizes = pages.groupBy("final").agg(F.sum("n").alias("group_size"))
    ids = entries.filter("won").select(F.col("row_id").alias("final"), F.col("doc_id").alias("keep_id"))
    per_page = pages.select("winner", "final").join(sizes.join(ids, "final"), "final")
    return (entries.select("row_id", "winner", "doc_id", "digest").join(per_page, "winner")
            .select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("final")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def keep(docs: DataFrame, page_rows: int = PAGE_ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    entries, lost = build(docs, with_rows=True, page_rows=page_rows)
    winners = entries.filter("won")
    stay = winners.filter("not paged").unionByName(
        winners.filter("paged").join(lost.select("row_id"), "row_id", "left_anti").select(*winners.columns))
    return stay.select(*[F.col(c) if c in ("text", "doc_id") else F.col("rest")[c].alias(c) for c in docs.columns])
