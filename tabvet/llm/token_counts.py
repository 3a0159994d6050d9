"""Operator 2: token counts by rank-synchronous array merging.

The texts of a batch are cut into pre-tokens; their distinct forms are held
as one ragged numpy array of symbols, and every round applies each sequence's
lowest-rank pair (the leftmost of equals) in all sequences at once, until no
sequence has a mergeable pair.  What survives is counted, and the counts are
gathered back per text.

The vocabulary is a sentencepiece BPE model; counts equal the library's,
without begin, end or added special tokens.

Defined results: a NULL text is an empty one (0 bytes, 0 tokens); repeated
rows are counted each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import body

#: Sequences of more symbols are merged with a heap each, not in rounds.
LONG = 512
#: Text bytes that are held as arrays at a time (a longer text is held alone).
SLICE_BYTES = 8 << 20

_SPACE = "▁"
_NONE = np.iinfo(np.int64).max


class Merges:
    """Symbols and pair ranks of a sentencepiece BPE model."""

    def __init__(self, model_file: str):
        import sentencepiece
        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [lib.id_to_piece(i) for i in range(lib.vocab_size())]
        plain = {p: lib.get_score(i) for i, p in enumerate(pieces)
                 if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))}
        byte_pieces = any(lib.is_byte(i) for i in range(lib.vocab_size()))
        symbols = {p: k for k, p in enumerate(plain)}
        cost = [1] * len(symbols)
        for p in plain:                       # characters that occur inside pieces only
            for ch in p:
                if ch not in symbols:
                    symbols[ch] = len(symbols)
                    cost.append(len(ch.encode()) if byte_pieces else 1)
        self.n = len(symbols)
        self.cost = np.array(cost, np.int64)
        self.byte_pieces = byte_pieces
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, k in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = k
        self.of_char[ord(" ")] = symbols.get(_SPACE, -1)
        rank = {s: r for r, s in enumerate(sorted({-v for v in plain.values()}))}
        pairs = []
        for p, score in plain.items():
            for cut in range(1, len(p)):
                a, b = symbols.get(p[:cut]), symbols.get(p[cut:])
                if a is not None and b is not None:
                    pairs.append((a * self.n + b, rank[-score], symbols[p]))
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs))
        # no piece goes on past a blank, so merges never cross the cut before one
        self.cut_at_blanks = not any(_SPACE in p.lstrip(_SPACE) for p in plain)
        probe = " Aﬁ 　é\t x  y "
        self.identity = lib.normalize(probe).replace(_SPACE, " ") == " " + probe and lib.normalize("") == ""

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in the table, -1 where it merges to nothing."""
        key = np.where((left < 0) | (right < 0), -1, left * self.n + right)
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, -1)

    def surviving(self, sym: np.ndarray, lengths: np.ndarray, char_bytes: np.ndarray) -> np.ndarray:
        """Number of tokens of each ragged sequence of symbols."""
        cost = np.where(sym < 0, char_bytes if self.byte_pieces else 1, self.cost[sym])
        out = np.zeros(len(lengths), np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        which = np.arange(len(lengths))
        for k in np.flatnonzero(lengths > LONG):
            out[k] = self._long(sym[starts[k]:starts[k + 1]], cost[starts[k]:starts[k + 1]])
        live = (lengths > 0) & (lengths <= LONG)
        take = np.repeat(live, lengths)
        sym, cost, lengths, which = sym[take], cost[take], lengths[live], which[live]
        first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        place = np.full(len(sym), -1, np.int64)
        if len(sym) > 1:
            place[:-1] = self.pair(sym[:-1], sym[1:])
        if len(lengths):
            place[first + lengths - 1] = -1           # the last symbol of a sequence has no pair
        while len(lengths):
            ranked = np.where(place < 0, _NONE, (self.ranks[place] << 40) | np.arange(len(place)))
            best = np.minimum.reduceat(ranked, first)
            done = best == _NONE
            if done.any():
                out[which[done]] = np.add.reduceat(cost, first)[done]
                stay = ~done
                take = np.repeat(stay, lengths)
                sym, cost, place = sym[take], cost[take], place[take]
                lengths, which, best = lengths[stay], which[stay], best[stay]
                if not len(lengths):
                    break
                shift = np.concatenate([[0], np.cumsum(~take)])[:-1]
                at = best & ((1 << 40) - 1)
                at = at - shift[at]
            else:
                at = best & ((1 << 40) - 1)
            new = self.merged[place[at]]
            sym[at] = new
            cost[at] = self.cost[new]
            place[at] = place[at + 1]                  # keeps the mark of a sequence's end
            ends = np.concatenate([[0], np.cumsum(lengths)])
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lengths = lengths - 1
            at = at - np.arange(len(at))               # one symbol went from each earlier sequence
            sym, cost, place = sym[keep], cost[keep], place[keep]
            first = ends[:-1] - np.arange(len(lengths))
            last = first + lengths - 1
            right = at < last
            place[at[right]] = self.pair(sym[at[right]], sym[at[right] + 1])
            place[at[~right]] = -1
            left = at > first
            place[at[left] - 1] = self.pair(sym[at[left] - 1], sym[at[left]])
        return out

    def _long(self, sym: np.ndarray, cost: np.ndarray) -> int:
        """The same merges in one long sequence, by a heap of its pairs."""
        s, c = sym.tolist(), cost.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table()

        def push(i):
            j = after[i]
            if j < n:
                got = table.get((s[i], s[j]))
                if got:
                    heapq.heappush(heap, (got[0], i, s[i], s[j], got[1]))

        heap: list = []
        for i in range(n - 1):
            push(i)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            if s[i] != a or after[i] >= n or s[after[i]] != b:
                continue
            j = after[i]
            s[i], c[i] = new, int(self.cost[new])
            s[j] = c[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return sum(x for x in c if x is not None)

    def _table(self) -> dict:
        if not hasattr(self, "_pairs"):
            self._pairs = {(int(k) // self.n, int(k) % self.n): (int(r), int(m))
                           for k, r, m in zip(self.keys, self.ranks, self.merged)}
        return self._pairs


@lru_cache(maxsize=2)
def load(model_file: str) -> Merges:
    return Merges(model_file)


def pre_tokens(texts: pa.Array, merges: Merges) -> tuple[pa.Array, np.ndarray]:
    """Pre-tokens of all texts in order, a leading blank written as a space,
    and the number of them per text."""
    if merges.identity:
        spaced = pc.replace_substring(texts, _SPACE, " ") if pc.any(pc.match_substring(texts, _SPACE)).as_py() else texts
        spaced = pc.if_else(pc.equal(pc.binary_length(spaced), 0), "",
                            pc.binary_join_element_wise(" ", spaced, ""))
    else:
        spaced = pa.array([merges.library.normalize(t).replace(_SPACE, " ") for t in texts.to_pylist()], pa.string())
    spaced = spaced.cast(pa.large_string())
    offsets = np.frombuffer(spaced.buffers()[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
    data = spaced.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    blank = raw == 32
    cut = np.zeros(len(raw) + 1, bool)
    if merges.cut_at_blanks and len(raw):
        cut[1:-1] = blank[1:] & ~blank[:-1]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    if offsets[0] > 0:
        cut[:offsets[0]] = False
    starts = np.flatnonzero(cut[:-1])
    bounds = np.append(starts, offsets[-1])
    tokens = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)),
                                              data if data is not None else pa.py_buffer(b""))
    per_text = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return tokens, per_text


def count(texts: pa.Array, merges: Merges) -> np.ndarray:
    """Tokens of each text of a string array without nulls."""
    tokens, per_text = pre_tokens(texts, merges)
    if not len(tokens):
        return np.zeros(len(texts), np.int64)
    coded = tokens.dictionary_encode()
    distinct = coded.dictionary
    lengths = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer("".join(distinct.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
    char_bytes = 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF).astype(np.int64)
    sizes = merges.surviving(merges.of_char[chars], lengths, char_bytes)
    each = sizes[coded.indices.to_numpy(zero_copy_only=False)]
    total = np.concatenate([[0], np.cumsum(each)])
    ends = np.cumsum(per_text)
    return total[ends] - total[ends - per_text]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, rows) of stretches of at most ``limit`` bytes or one row."""
    sizes = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + limit, "right")) - 1)
        yield first, last - first
        first = last


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(model_file)
        for batch in batches:
            texts = batch.column("text")
            n = [count(texts.slice(a, k), merges) for a, k in slices(texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pc.binary_length(texts).cast(pa.int64()),
                 pa.array(np.concatenate(n) if n else [], pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    counted = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text"))
               .mapInArrow(rows, "doc_id long, n_bytes long, n_tokens long"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
