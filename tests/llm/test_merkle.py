import hashlib
import zlib

from helpers_llm import awkward, empty
from pyspark.sql import functions as F

from tabvet.llm import merkle as n


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    vals = (r.doc_id, r.source, r.lang, r.n_chars, text)
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals])


def grow(nodes):
    """All levels of a tree, lowest first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        level = levels[-1]
        levels.append([H(*level[i:i + 8]) for i in range(0, len(level), 8)])
    return levels


def path(levels, pos):
    out = []
    for level in levels[:-1]:
        first = pos // 8 * 8
        out.append((level[first:pos], level[pos + 1:first + 8]))
        pos //= 8
    return out


def brute(rows):
    low = str.maketrans(n.UPPER, n.LOWER)
    by_lang = {}
    for r in rows:
        own = leaf(r, r.text)
        hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
        shown = leaf(r, r.text.translate(low) if r.text is not None else None) if hit else own
        by_lang.setdefault(r.lang, []).append(((r.doc_id is not None, r.doc_id or 0, own), r.doc_id, own, shown))
    names = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {la: grow([x[2] for x in sorted(by_lang[la])]) for la in names}
    top = grow([trees[la][-1][0] for la in names])
    out = []
    for k, la in enumerate(names):
        for pos, (_, doc_id, own, shown) in enumerate(sorted(by_lang[la])):
            steps = path(trees[la], pos) + path(top, k)
            now = shown
            for before, after in steps:
                now = H(*before, now, *after)
            proof = H(*[x for b, a in steps for x in (*b, *a)])
            out.append((doc_id, own, trees[la][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=repr)


def check(docs):
    got = n.verify(n.manifest(docs, n.lower_cased)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs.collect())
    return got


def test_awkward_and_empty_tables(spark):
    check(awkward(spark))
    assert n.verify(n.manifest(empty(spark), n.lower_cased)).count() == 0


def test_several_rounds_hot_language_and_many_languages(spark):
    docs = (spark.range(10_000).select(
        F.when(F.col("id") % 11 == 0, F.lit(None).cast("long")).when(F.col("id") % 5 == 0, F.lit(77))
        .otherwise(F.col("id") * 7 % 9_973).alias("doc_id"),
        F.concat(F.lit("Text "), F.col("id") % 4_000).alias("text"),
        F.when(F.col("id") < 6_000, "en").when(F.col("id") < 9_000, F.concat(F.lit("é"), F.col("id") % 700))
        .alias("lang"), F.lit("src0").alias("source"), F.col("id").alias("n_chars"), F.lit(1).alias("pos"),
        F.lit("x").alias("node")))
    got = check(docs)
    assert len(got) == 10_000 and {r.verified for r in got} == {True, False}


def test_one_row_and_equal_rows(spark):
    one = spark.createDataFrame([(3, "A b", "en", "src0", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    row = check(one)[0]
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == H()
    check(one.unionByName(one).unionByName(one))


def test_other_fields_are_not_forgiven(spark):
    docs = awkward(spark, clash=False)
    got = n.verify(n.manifest(docs, lambda d: n.leaf(d, source=F.lit("elsewhere")))).collect()
    assert not any(r.verified for r in got)
    assert all(r.verified for r in n.verify(n.manifest(docs)).collect())
