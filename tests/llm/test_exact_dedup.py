import collections
import hashlib
import re

from helpers_llm import awkward, empty

from tabvet.llm import exact_dedup as d


def squeeze(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def expected(rows):
    """Brute force: {squeezed: (keep doc_id, size)}; NULL ids last."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[squeeze(r.text)].append(r)
    best = {k: min(v, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for k, v in groups.items()}
    return {k: (best[k].doc_id, len(v)) for k, v in groups.items()}


def check(docs, **params):
    rows = docs.collect()
    want = expected(rows)
    got = d.groups(docs, **params).collect()
    assert len(got) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert collections.Counter((r.text_sha256, r.keep_id, r.group_size) for r in got) == collections.Counter(
        {(h, *v): v[1] for h, v in by_hash.items()})
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = d.keep(docs, **params)
    assert kept.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == collections.Counter(
        (v[0], next(r.text for r in rows if squeeze(r.text) == k and r.doc_id == v[0]
                    and len(r.text or "") == max(len(x.text or "") for x in rows if squeeze(x.text) == k)))
        for k, v in want.items())


def test_awkward_rows(spark):
    check(awkward(spark))


def test_empty_table(spark):
    assert d.groups(empty(spark)).count() == 0
    assert d.keep(empty(spark)).count() == 0


def test_hot_group_goes_through_pages(spark):
    rows = [(i, "same text" + " " * (i % 7) if i % 3 else f"text {i}") for i in range(900)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), page_rows=8)


def test_colliding_keys_are_chained(spark, monkeypatch):
    import pyarrow as pa
    rows = [{"row_id": i, "doc_id": i, "n_chars": 1, "key": 5, "page": 0, "text": t, "paged": False}
            for i, t in enumerate(["a", "b", "a ", "c", "b"])]
    out = [r for b in d._owner(iter([pa.RecordBatch.from_pylist(rows[:3]), pa.RecordBatch.from_pylist(rows[3:])]))
           for r in b.to_pylist()]
    assert [r["winner"] for r in out] == [0, 1, 0, 3, 1]
    assert [r["text"] for r in out] == ["a", "b", None, "c", None]


def test_directory_doubles_only_overfull_buckets():
    directory = d.double_directory({0: 50, 1: 50, 2: 1, 5: 500, 6: 3}, 3, 100)
    assert len(directory) == 8
    assert directory[0] == directory[1] == directory[2] == directory[3] or sum((50, 50, 1)) > 100
    assert directory.count(directory[5]) == 1          # a single prefix can't be split further
    assert directory[6] == directory[7]
