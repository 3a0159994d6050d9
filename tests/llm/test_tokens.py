import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers_llm import awkward, empty

from tabvet.llm import encoding, packing, simple8b, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "B", " ", "  ", "▁", "é", "漢", "字", "\U0001F600", "\n", "\t", "\x0b", "\x1c", "\x85", " ", "the",
            " Ing", "0", "12", "\x00", "\x01", "ﬁ", "<s>", "</s>", "<unk>", "<0x41>", "<|endoftext|>", "'s", "don't", ".",
            ",", "...", "J̌", "İ", "Σ", "́"]


def noise(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(n)] + ["", " "]


def test_counts_equal_the_library():
    merges = token_counts.load(PIECES)
    texts = noise(1500, 1) + ["a" * 3000, "漢字" * 700, "=-" * 900, " " * 1500, "theing" * 400]
    assert token_counts.count(pa.array(texts), merges).tolist() == [len(x) for x in merges.library.encode(texts)]


def test_heap_and_rounds_agree(monkeypatch):
    merges = token_counts.load(PIECES)
    texts = pa.array(noise(300, 2))
    rounds = token_counts.count(texts, merges)
    monkeypatch.setattr(token_counts, "LONG", 1)
    assert (token_counts.count(texts, merges) == rounds).all()


def test_word_ids_equal_the_library(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT_WORDS", 300)          # forgets words all the time
    encoder = encoding.WordEncoder(WORDS)
    for seed in range(4):
        texts = noise(300, 10 + seed)
        ids, per = encoder.encode(pa.array(texts), 1)
        ends = np.cumsum(per)
        for t, a, b in zip(texts, ends - per, ends):
            assert encoder.library.encode(t, add_special_tokens=False).ids + [1] == ids[a:b].tolist()


def test_simple8b_round_trip():
    r = np.random.default_rng(1)
    for k in range(200):
        n = int(r.integers(0, 400))
        wide = r.integers(0, 2 ** 63, n, dtype=np.uint64) >> r.integers(0, 64, n).astype(np.uint64)
        narrow = r.integers(0, [1, 2, 9, 50_000][k % 4], n).astype(np.uint64)
        for v in (wide, narrow):
            assert (simple8b.decode(simple8b.encode(v), n) == v).all()


def library_ids(rows):
    lib = encoding.load(WORDS).library
    return [lib.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("make", [awkward, empty])
def test_token_files(spark, make):
    docs = make(spark)
    got = simple8b.digest(simple8b.round_trip(docs, WORDS)).collect()
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    want, start = [], 0
    for r, ids in zip(rows, library_ids(rows)):
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda x: x[1]) == want


@pytest.mark.parametrize("make", [awkward, empty])
def test_packing(spark, make):
    docs = make(spark)
    rows = docs.collect()
    packed = packing.pack(docs, WORDS)
    pieces = packing.digest(packed).collect()
    assert sorted(p.sequence_id for p in pieces) == list(range(len(pieces)))
    want = []
    for r, ids in zip(rows, library_ids(rows)):
        at = 0
        while at < len(ids):
            n = min(2048, 1 << ((len(ids) - at).bit_length() - 1))
            want.append((r.doc_id, at, n, crc(ids[at:at + n]), len(ids)))
            at += n
    order = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces), key=order) == sorted(
        want, key=order)
    assert all(p.offset == 0 for p in pieces)
    lengths = [p.length for p in sorted(pieces, key=lambda p: p.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)


@pytest.mark.parametrize("make", [awkward, empty])
def test_token_counts(spark, make):
    docs = make(spark)
    lib = token_counts.load(PIECES).library
    got = token_counts.token_counts(docs, PIECES).collect()
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got] == [
        (r.doc_id, len((r.text or "").encode()), n := len(lib.encode(r.text or "")), n > 4096) for r in docs.collect()]
