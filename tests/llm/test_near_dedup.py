import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from helpers_llm import WORD, awkward, empty, prose

from tabvet.llm import near_dedup as n
from tabvet.llm.components import components
from tabvet.llm.shingles import elements, overlap, shingles


def bag(text):
    w = WORD.findall(text or "")
    if len(w) < 5:
        return Counter([tuple(w)]) if w else Counter()
    return Counter(zip(*[w[i:] for i in range(5)]))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows):
    """(id, text) -> class and whether it stays, by all pairs."""
    known = sorted({r for r in rows if r[0] is not None and bag(r[1])})
    mark = {t: h for t, h in {(t, marks[t]) for _, t in known}}
    label = {r: (r[0], mark[r[1]]) for r in known}
    bags = [(r, bag(r[1])) for r in known]
    links = [(a, b) for k, (a, x) in enumerate(bags) for b, y in bags[:k] if jaccard(x, y) >= 0.8]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return [(i, label[i, t][0], label[i, t] == (i, mark[t])) if (i, t) in label else (i, i, True) for i, t in rows]


marks = {}


def check(docs):
    from pyspark.sql import functions as F
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    marks.update({r.text: r.h for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()})
    want = brute(rows)
    got = n.classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.kept) for r in got) == Counter(want)
    kept = n.keep(docs)
    assert kept.columns == docs.columns
    stay = {r for r, (_, _, k) in zip(rows, want) if k and r[0] is not None}
    out = [(r.doc_id, r.text) for r in kept.collect()]
    empties = {r for r in rows if not bag(r[1])}
    assert sorted(x for x in out if x[0] is not None and x not in empties) == sorted(x for x in stay if x not in empties)
    assert {x[0] for x in out if x in empties} == {x[0] for x in empties}
    assert sum(x[0] is None for x in out) == sum(i is None for i, _ in rows)


def test_awkward_rows(spark):
    check(awkward(spark))


def test_different_texts_under_one_id(spark):
    a, b, c = prose(60, 21), prose(60, 22), prose(60, 23)
    near_a, near_b = a.replace(a.split()[30], "changed", 1), b.replace(b.split()[30], "changed", 1)
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (5, c), (7, near_b), (2, near_a), (7, a), (9, c), (9, c), (5, c + " "),
                                  (4, None), (4, ""), (4, a)], "doc_id long, text string")
    check(docs)
    kept = {(r.doc_id, r.text) for r in n.keep(docs).collect()}
    assert (5, b) in kept and (2, near_a) in kept and len({t for i, t in kept if i == 5 and t.strip() == c}) == 1


def test_empty_table(spark):
    assert n.classes(empty(spark)).count() == 0
    assert n.keep(empty(spark)).count() == 0


def test_overlap_is_weighted_jaccard():
    r = random.Random(2)
    for _ in range(50):
        a = " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        b = " ".join(r.choice("ab") for _ in range(r.randint(0, 60)))
        if WORD.findall(a) and WORD.findall(b):
            assert abs(overlap(elements(a, 5), elements(b, 5)) - jaccard(bag(a), bag(b))) < 1e-12


def test_signatures_are_unbiased():
    base = prose(150, 3).split()
    changed = base[:60] + ["new"] + base[61:]
    texts = [" ".join(base + ["x y z u v"] * 20), " ".join(changed + ["x y z u v"] * 7)]
    hashes, per = shingles(pa.array(texts), 5)
    weighted = n._weighted(hashes, np.repeat(np.arange(2), per))
    times = n.signatures(*weighted, 2, 20_000)
    assert abs((times[0] == times[1]).mean() - jaccard(bag(texts[0]), bag(texts[1]))) < 0.015


def test_links_past_the_pivot_are_found(spark, monkeypatch):
    """Variants of one text, some of them near to each other but not to it."""
    r = random.Random(5)
    base = prose(120, 9).split()
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.randint(0, 3)}"
        rows.append((i, " ".join(w)))
    for i in range(60, 70):
        w = rows[i - 50][1].split()
        w[i - 50] = "again"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(n, "TILE", 16)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_components_against_union_find(spark):
    r = random.Random(7)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)]
    links += [(500, k) for k in range(501, 560)]
    got = {x.node: x.label for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    seen = {}
    for start in sorted(near):
        if start not in seen:
            todo = [start]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen[x] = start
                    todo += near[x]
    assert got == seen


def test_members_far_from_their_pivot_are_compared(spark):
    """Bucket 1 has a pivot that is like none of its members; two of them are
    near-duplicates of one another, two more are like nothing."""
    words = prose(60, 41).split()
    texts = {0: prose(60, 40), 1: " ".join(words), 2: " ".join(words[:59] + ["other"]), 3: prose(60, 42),
             4: prose(60, 43), 5: prose(60, 44)}
    # node 0 meets the most others, so it is the pivot of both buckets
    keys = {0: [1, 2], 1: [1], 2: [1], 3: [1], 4: [1], 5: [2]}
    from pyspark.sql import functions as F
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    reps = (docs.select(F.col("doc_id").alias("node"), "doc_id", F.xxhash64("text").alias("mark"))
            .join(spark.createDataFrame(list(keys.items()), "node long, keys array<long>"), "node"))
    assert {tuple(sorted(r)) for r in n.links(reps, docs).collect()} == {(1, 2)}


def test_shared_halves(spark):
    """Texts put together from common halves meet in buckets whose pivot is
    like only one half of them."""
    halves = [prose(40, 50 + k) for k in range(6)]
    rows = [(10 * a + b, f"{halves[a]} {halves[b]}") for a in range(6) for b in range(6) if a != b]
    rows += [(100 + i, t.rsplit(" ", 1)[0] + " end") for i, t in rows[::3]]
    check(spark.createDataFrame(rows, "doc_id long, text string"))
