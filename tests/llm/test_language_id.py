import re
import zlib
from collections import Counter

import pytest
from helpers_llm import awkward, empty

from tabvet.llm import language_id as n
from tabvet.llm.queries import QUERIES


def grams(text):
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in (text or "").lower())):
        padded = f" {word} "
        for size in (1, 2, 3):
            out.update(g for g in (padded[i:i + size] for i in range(len(padded) - size + 1)) if g.strip())
    return out


def profile(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], [0] * (3 - len(x[0])) + [ord(c) for c in x[0]]))[:size]]


def brute(rows, size):
    by = {}
    for doc_id, text, lang in rows:
        if doc_id is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 3 != 1:
            by.setdefault(lang, Counter()).update(grams(text))
    tables = {la: {g: r for r, g in enumerate(profile(c, size))} for la, c in by.items() if c}
    for doc_id, text, _ in rows:
        own = profile(grams(text), size)
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
        far = sorted((sum(abs(t[g] - r) if g in t else size for r, g in enumerate(own)), la) for la, t in tables.items())
        if not own or not far:
            yield doc_id, held, "und", 0.0
        else:
            second = far[1][0] if len(far) > 1 else size * len(own)
            yield doc_id, held, far[0][1], (second - far[0][0]) / second if second else 0.0


def check(docs, size):
    got = n.predict(docs, n.learn(docs, size)).collect()
    want = list(brute([(r.doc_id, r.text, r.lang) for r in docs.collect()], size))
    assert [tuple(r)[:3] for r in got] == [w[:3] for w in want]
    assert [r.score for r in got] == pytest.approx([w[3] for w in want])
    assert all(0 <= r.score <= 1 for r in got)
    return got


@pytest.mark.parametrize("size", [5, 60, 1000])
def test_awkward_tables(spark, size):
    extra = [(20, "Ünïted – Straße, 123 ß_ſ", "de", "s", 1), (21, "12 34 ... ###", "en", "s", 1), (22, "漢字 kana カナ", "ja", "s", 1),
             (23, "a\nb", "", "s", 1), (24, "İstanbul ŉ ǰ", "tr", "s", 1)]
    docs = awkward(spark, clash=False).unionByName(spark.createDataFrame(extra, awkward(spark, clash=False).schema))
    got = check(docs, size)
    assert {r.doc_id: r.lang_pred for r in got}[21] == "und"


def test_clashes_empty_table_and_nothing_learnt(spark):
    docs = awkward(spark)
    assert n.predict(docs, n.learn(docs)).count() == docs.count()
    assert n.predict(empty(spark), n.learn(empty(spark))).count() == 0
    model = n.learn(docs.filter("lang IS NULL"))
    assert {(r.lang_pred, r.score) for r in n.predict(docs, model).collect()} == {("und", 0.0)}


def test_many_letters_take_the_wide_path():
    import numpy as np
    texts = ["".join(chr(0x4E00 + k * 7 % 20_000) for k in range(j, j + 3000)) + " end" for j in (0, 5)]
    plain = n.counted(texts, np.array([0, 1 << 20]))
    wide = n.counted(texts, np.array([0, 1 << 40]))
    assert (plain[1] == wide[1]).all() and (plain[2] == wide[2]).all()


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(n, "MAX_LANGUAGES", 0)
    with pytest.raises(ValueError, match="languages"):
        n.learn(awkward(spark))


def test_partial_counts_are_sent_on(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sent = [b for b in n._counts(iter(docs.select("lang", "text").toArrow().to_batches(max_chunksize=20)))]
    monkeypatch.setattr(n, "HELD", 2_000)
    parts = [b for b in n._counts(iter(docs.select("lang", "text").toArrow().to_batches(max_chunksize=20)))]
    assert len(parts) > len(sent)
    total = [Counter(), Counter()]
    for out, batches in zip(total, (sent, parts)):
        for b in batches:
            for lang, gram, k in zip(*(c.to_pylist() for c in b.columns)):
                out[lang, gram] += k
    assert total[0] == total[1]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op11_language_id"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = got.join(docs, "doc_id").filter("held_out").collect()
    assert len(held) > 250 and sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
