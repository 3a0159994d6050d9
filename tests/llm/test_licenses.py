import re

import pytest
from helpers_llm import awkward, empty

from tabvet.llm import licenses as n


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    places = []
    for phrase, label in n.BASE_PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in places})))


TEXTS = [
    "Licensed under CC BY-NC 4.0. cc by cc by", "GNU General\nPublic--License and general public licenses",
    "all rights reserved all rights reserved. ALL RIGHTS\tRESERVED", "accc by cc byé cc by",
    "// SPDX-License-Identifier: MIT OR (GPL-2.0-only WITH Classpath-exception-2.0 AND BSD-3-Clause) */", None, "",
    "SPDX-License-Identifier: MIT OR\nnext", "é" * 40_000 + " cc by",
]


def test_base_columns(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").unionByName(
        awkward(spark, clash=False).select("doc_id", "text"))
    got = n.digest(n.scan(docs)).collect()
    want = [brute(r.text) for r in docs.collect()]
    assert [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert got[4].labels == "bsd-3-clause,gpl-2.0-only,mit"
    assert got[7].expressions == []


def test_clashing_columns_and_empty_table(spark):
    assert n.digest(n.scan(awkward(spark))).count() == awkward(spark).count()
    assert n.digest(n.scan(empty(spark))).count() == 0


@pytest.mark.parametrize("text, steps", [
    ("a or b and c", ["a", "b", "c", "and", "or"]), ("(a or b) and c", ["a", "b", "or", "c", "and"]),
    ("a with b and c", ["a", "b", "with", "c", "and"]), ("a and b or c", ["a", "b", "and", "c", "or"]),
    ("a or", None), ("(a", None), ("a)", None), ("a b", None), ("", None), ("and a", None), ("()", None)])
def test_shunting_yard(text, steps):
    assert n.postfix(text) == steps


def test_restrictions():
    assert n.evaluate("MIT OR GPL-3.0")[1] == n.RESTRICTION["mit"]
    assert n.evaluate("MIT AND GPL-3.0")[1] == n.RESTRICTION["gpl-3.0"]
    assert n.evaluate("GPL-2.0 WITH x-exception") == (["gpl-2.0"], n.RESTRICTION["gpl-2.0"] / 2)
    assert n.evaluate("(MIT) WITH (a or b)") is None


@pytest.mark.parametrize("text, labels", [
    ("SPDX License Identifier: MIT", ["mit"]), ("spdx--license\tidentifier : MIT or ISC", ["isc", "mit"]),
    ("SPDX-License-Identifier MIT", None), ("xSPDX-License-Identifier: MIT", None), ("SPDX-License-Identifier:", None),
    ("SPDX-License-Identifier: MIT OR", None), ("a\r\n# SPDX-License-Identifier: (MIT) --> b", ["mit"]),
    ("SPDX-License-Identifier: MIT WITH x AND GPL-2.0 WITH x AND x", ["gpl-2.0", "mit", "x"])])
def test_tags(text, labels):
    found = n.find(text.encode(), ((n.TAG, ""),))[2]
    assert [e["labels"] for e in found] == ([] if labels is None else [labels])


def test_expressions_line_by_line():
    text = "é SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC SPDX-License-Identifier: MIT\nspdx license identifier: zlib"
    assert [e["labels"] for e in n.find(text.encode(), ((n.TAG, ""),))[2]] == [["mit"], ["zlib"]]


def test_long_expressions_take_linear_time():
    import time
    ids = [f"l{k}" for k in range(300_000)]
    start = time.time()
    for text in (" OR ".join(ids), "(" * 500_000 + "a" + ")" * 500_000, " AND ".join(ids) + " OR", "SPDX-License-Identifier: " * 100_000,
                 " ".join(ids)):
        n.find(b"SPDX-License-Identifier: " + text.encode(), ((n.TAG, ""),))
    assert n.evaluate(" OR ".join(ids)) == (sorted(ids), n.UNKNOWN_RESTRICTION)
    assert time.time() - start < 20


def brute_method(text):
    """Labels and score by searching every phrase and every line."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    line = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)) + " "
    found = {label for phrase, label in (n.BASE_PHRASES | n.NOTICE_PHRASES).items() if f" {phrase} " in line}
    levels = [n.RESTRICTION[x] for x in found]
    for m in re.finditer(r"(?<![^\x00-\x2f\x3a-\x60\x7b-\x7f])spdx[\x00-\x2f\x3a-\x60\x7b-\x7f]+license"
                         r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+identifier[ \t]*:([^\r\n]*)", low):
        value = n.evaluate(re.split(r"\*/|-->|\*\)", m[1])[0].strip())
        if value:
            found |= set(value[0])
            levels.append(value[1])
    return ",".join(sorted(found)), max(levels, default=0.0)


def test_labels_and_score_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(
        spark.createDataFrame(list(enumerate(TEXTS, 10_000)), "doc_id long, text string"))
    want = {r.doc_id: brute_method(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.labels, r.score) for r in n.digest(n.scan(docs)).collect()}
    assert got == want and len({x for x, _ in got.values()}) > 3
