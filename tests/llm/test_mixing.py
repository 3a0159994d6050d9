import hashlib
from collections import defaultdict

from helpers_llm import WORD, awkward, empty

from tabvet.llm import mixing as m


def share(budget, children):
    """{name: (weight, capacity)} -> {name: tokens}, by definition: whoever
    can't use a share of what is left is filled up first."""
    out, left = {}, dict(children)
    while left:
        weights = sum(w for w, _ in left.values())
        full = sorted((c / w if w else -1.0, k) for k, (w, c) in left.items())
        k = full[0][1]
        w, c = left[k]
        if budget * w >= c * weights:
            out[k] = c
            budget -= c
            del left[k]
        else:
            return out | {k: budget * w // weights for k, (w, c) in left.items()}
    return out


def domain(source):
    number = source[3:] if source.startswith("src") and source[3:].isdigit() else ""
    n = int(number) if number else None
    return "reference" if n is None or n > 13 else "web" if n == 0 else "forum" if n <= 6 else "news"


def brute(rows, max_epochs=2):
    docs = [(r.doc_id, domain(r.source or ""), r.lang or "", r.source or "", len(WORD.findall(r.text or ""))) for r in rows]
    avail = defaultdict(int)
    for d in docs:
        avail[d[1:4]] += d[4]
    weight = lambda level, name: m.WEIGHTS[level].get(name, m.DEFAULT_WEIGHT)
    cap = {k: v * max_epochs for k, v in avail.items()}
    total = min(sum(cap.values()), sum(avail.values()) * 3 // 5)
    level1 = share(total, {d: (weight("domain", d), sum(c for k, c in cap.items() if k[0] == d)) for d, _, _ in cap})
    budget = {}
    for d, b in level1.items():
        langs = {k[1] for k in cap if k[0] == d}
        for lang, b2 in share(b, {x: (weight("lang", x), sum(c for k, c in cap.items() if k[:2] == (d, x)))
                                  for x in langs}).items():
            for s, b3 in share(b2, {k[2]: (weight("source", k[2]), c) for k, c in cap.items() if k[:2] == (d, lang)}).items():
                budget[d, lang, s] = b3
    out = []
    for leaf, n in avail.items():
        full, rest = divmod(budget[leaf], n) if n else (0, 0)
        mine = [d for d in docs if d[1:4] == leaf]
        key = lambda d: hashlib.md5(f"{m.SEED}:{full}:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:15]
        used = 0
        upto = {}
        for k in sorted({key(d) for d in mine}):
            used += sum(d[4] for d in mine if key(d) == k)
            upto[k] = used
        out += [(*d, full + int(rest > 0 and upto[key(d)] <= rest)) for d in mine]
    return out


def order(x):
    return tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in x)


def test_choice_equals_definition(spark):
    docs = awkward(spark)
    got = m.choose(docs)
    assert got.columns == ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]
    assert sorted(map(tuple, got.collect()), key=order) == sorted(brute(docs.collect()), key=order)


def test_mix_repeats_and_keeps_columns(spark):
    docs = awkward(spark)
    mixed = m.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in m.choose(docs).collect())
    once = m.mix(docs, max_epochs=1)
    assert once.count() == sum(x[-1] for x in brute(docs.collect(), 1))


def test_shortage_goes_to_siblings_first(spark):
    units = spark.createDataFrame(
        [("web", "en", "a", 100), ("web", "en", "b", 10_000), ("web", "de", "c", 10_000), ("news", "en", "d", 10_000)],
        "domain string, lang string, source string, tokens long")
    weights = {"domain": {"web": 1, "news": 1}, "lang": {"en": 1, "de": 1}, "source": {}}
    got = {r.source: r.budget for r in m.budgets(units, (8000, 30_100), 1, weights, 1).collect()}
    assert got == {"a": 100, "b": 1900, "c": 2000, "d": 4000}


def test_empty_table(spark):
    assert m.choose(empty(spark)).count() == 0
    assert m.mix(empty(spark)).count() == 0
