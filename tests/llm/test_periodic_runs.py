import hashlib
import random
import re
import zlib

import numpy as np
from helpers_llm import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from tabvet.llm import periodic_runs as n
from tabvet.llm.queries import QUERIES


def brute(words):
    """Every period, every maximal stretch, smallest period of each."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)]
        i = 0
        while i < len(same):
            j = i
            while j < len(same) and same[j]:
                j += 1
            length = j - i + q
            if length >= max(12, 2 * q):
                out.setdefault((i, length), q)
            i = j + 1
    return sorted((s, ln, q) for (s, ln), q in out.items())


def replant(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, k = h // 10, len(words)
        if h % 10 == 0 and k:
            a = g % k
            p = 1 + (k - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, k)]
    return words


def row(doc_id, text):
    words = replant(doc_id, text)
    runs = brute(words)
    drop = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    rest = " ".join(w for i, w in enumerate(words) if i not in drop)
    best = min(((-ln, s, q) for s, ln, q in runs), default=None)
    four = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    lines = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
    return (doc_id, len(words), len(runs), *four, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)))


def of(words):
    return next(iter(n._texts([" ".join(words).encode()])))[1]


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 4).flatmap(lambda k: st.lists(st.sampled_from("abcd"[:k]), max_size=90)))
def test_all_runs_of_small_alphabets(words):
    assert of(words) == brute(words)


def test_nested_periods_and_special_words():
    fib = ["a", "b"]
    while len("".join(fib[-1])) < 300:
        fib.append(fib[-1] + fib[-2])
    thue = [str(bin(i).count("1") % 2) for i in range(256)]
    inner = (["x"] * 7 + ["y"]) * 5 + ["z"] + (["x"] * 7 + ["y"]) * 4
    for words in (list(fib[-1]), thue, inner, ["a"] * 200, ["a"] * 11, ["a"] * 12, list("abcdef") * 2, list("abcde") * 2):
        assert of(words) == brute(words)


def test_texts_do_not_meet():
    r = random.Random(4)
    texts = [" ".join(r.choice("ab") for _ in range(r.randint(0, 60))) for _ in range(60)] + ["a " * 6, "a " * 6]
    got = [runs for _, runs in n._texts([t.encode() for t in texts])]
    assert got == [brute(t.split()) for t in texts]


def test_one_word_many_times():
    assert of(["a"] * 100_000) == [(0, 100_000, 1)]
    unit = [f"w{k}" for k in range(3_000)]
    assert of(["p"] + unit * 20 + unit[:5] + ["q"]) == [(1, 60_005, 3_000)]


def test_ranks_are_the_suffix_order():
    codes = np.array([2, 1, 2, 1, 2, 1, 0])
    last = n.doubled(codes)[-1]
    assert [tuple(codes[i:]) for i in np.argsort(last)] == sorted(tuple(codes[i:]) for i in range(7))


def test_awkward_tables(spark):
    docs = awkward(spark).filter("doc_id IS NULL OR doc_id <> 11")
    got = n.digest(n.runs(n.planted(docs))).collect()
    assert [tuple(r) for r in got] == [row(r.doc_id, r.text) for r in docs.collect()]
    assert n.digest(n.runs(n.planted(empty(spark)))).count() == 0


def test_query_on_a_whole_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(i, " ".join((t or "").split(" ")[:400])) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(row(*r) for r in rows)
    assert sum(r.n_runs > 0 for r in got) > 10
