import random

import pytest
from helpers_llm import WORD, awkward, empty, labels, prose

from tabvet.llm import quality_rules as q


def brute(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {x for ps in at.values() if len(ps) > 1 for p in ps for x in (p, p + 1, p + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_counts_equal_brute_force(spark):
    docs = awkward(spark)
    got = [tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
           for r in q.judge(docs, []).collect()]
    assert got == [brute(r.text) for r in docs.collect()]


def test_random_repeats(spark):
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.n_repeat_words for x in q.judge(df, []).orderBy("doc_id").collect()] == [brute(t)[4] for t in texts]


def test_empty_tables(spark):
    assert q.learned_rules(empty(spark), labels(spark, [])) == []
    assert q.judge(empty(spark), []).count() == 0
    assert q.learned_rules(awkward(spark), labels(spark, [(1, None, None), (None, 0, 0)])) == []


@pytest.fixture(scope="module")
def noisy(spark):
    rows = []
    for i in range(400):
        text = prose(80, 100 + i)
        if i % 4 == 0:
            text = " ".join(w + "***" for w in text.split())
        rows.append((i, text))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, labels(spark, [(i, int(i % 4 != 0), 0) for i in range(0, 400, 2)])


def test_learns_a_rule_and_keeps_clean_texts(spark, noisy):
    docs, marks = noisy
    rules = q.learned_rules(docs, marks)
    assert rules and all(r.precision >= 0.9 for r in rules)
    kept = {r.doc_id for r in q.judge(docs, rules).filter("kept").collect()}
    assert not any(i % 4 == 0 for i in kept)
    assert len(kept) >= 0.98 * 300
    assert {r.doc_id for r in q.keep(docs, rules).collect()} == kept


def test_keep_returns_the_columns(spark):
    docs = awkward(spark)
    rule = q.Rule((q.Condition("symbol_ratio", ">=", 0.5),), 1.0, 10)
    kept = q.keep(docs, [rule])
    assert kept.columns == docs.columns
    judged = q.judge(docs, [rule]).filter("kept").count()
    assert kept.count() == judged
    assert 17 not in {r.doc_id for r in kept.collect()}
    assert q.judge(docs, [rule]).filter("doc_id = 5").head().base_failed
