"""Registered queries of the operators of this subpackage and their SQL.

Each query applies its operator to its whole table with production
parameters; ``ORACLE_SQL`` has DuckDB text where SQL can state the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabvet.llm.common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the learned list's verdict for every document."""
    from tabvet.llm import quality_rules
    docs = documents(spark, sf_dir)
    return quality_rules.judge(docs, quality_rules.learned_rules(docs, table(spark, sf_dir, "labels")))


@_query
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts (blanks deleted) and the row that stays."""
    from tabvet.llm import exact_dedup
    return exact_dedup.groups(documents(spark, sf_dir))


ORACLE_SQL["op6_exact_dedup"] = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM g
"""


@_query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, labels and restriction of every document."""
    from tabvet.llm import licenses
    return licenses.digest(licenses.scan(documents(spark, sf_dir)))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    from tabvet.llm import token_counts
    return token_counts.token_counts(documents(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


@_query
def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written to Simple-8b files and read back."""
    from tabvet.llm import simple8b
    return simple8b.digest(simple8b.round_trip(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


@_query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into power-of-two sequences."""
    from tabvet.llm import packing
    return packing.digest(packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the target mixture takes each document."""
    from tabvet.llm import mixing
    return mixing.choose(documents(spark, sf_dir))


ORACLE_SQL["op5_mixing"] = r"""
WITH u AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens,
         TRY_CAST(nullif(regexp_extract(coalesce(source, ''), '^src([0-9]{1,4})$', 1), '') AS INT) AS num
  FROM documents),
units AS (
  SELECT doc_id, lang, source, tokens,
         CASE WHEN num = 0 THEN 'web' WHEN num <= 6 THEN 'forum' WHEN num <= 13 THEN 'news'
              ELSE 'reference' END AS domain
  FROM u),
n3 AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, 5 AS w, CAST(2 * sum(tokens) AS HUGEINT) AS cap
  FROM units GROUP BY ALL),
n2 AS (
  SELECT domain, lang, sum(cap) AS cap,
         CASE lang WHEN 'en' THEN 60 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 10 ELSE 5 END AS w
  FROM n3 GROUP BY domain, lang),
n1 AS (
  SELECT domain, sum(cap) AS cap,
         CASE domain WHEN 'web' THEN 40 WHEN 'forum' THEN 15 WHEN 'news' THEN 25 WHEN 'reference' THEN 20 END AS w
  FROM n2 GROUP BY domain),
p1 AS (
  SELECT *, row_number() OVER o AS n, sum(cap) OVER o AS upto, sum(w) OVER o AS wupto, sum(w) OVER () AS wall,
         (SELECT least((SELECT sum(cap) FROM n1), (SELECT sum(tokens) FROM n3) * 3 // 5)) AS budget
  FROM n1 WINDOW o AS (ORDER BY cap / w, domain)),
c1 AS (
  SELECT min(n) AS n, arg_min(budget - upto + cap, n) AS rest, arg_min(wall - wupto + w, n) AS weights
  FROM p1 WHERE (budget - upto + cap) * w < cap * (wall - wupto + w)),
b1 AS (
  SELECT domain, CASE WHEN c1.n IS NULL OR p1.n < c1.n THEN cap ELSE rest * w // weights END AS budget
  FROM p1, c1),
p2 AS (
  SELECT n2.*, b1.budget, row_number() OVER o AS n, sum(cap) OVER o AS upto, sum(w) OVER o AS wupto,
         sum(w) OVER (PARTITION BY domain) AS wall
  FROM n2 JOIN b1 USING (domain) WINDOW o AS (PARTITION BY domain ORDER BY cap / w, lang)),
c2 AS (
  SELECT domain, min(n) AS n, arg_min(budget - upto + cap, n) AS rest, arg_min(wall - wupto + w, n) AS weights
  FROM p2 WHERE (budget - upto + cap) * w < cap * (wall - wupto + w) GROUP BY domain),
b2 AS (
  SELECT domain, lang, CASE WHEN c2.n IS NULL OR p2.n < c2.n THEN cap ELSE rest * w // weights END AS budget
  FROM p2 LEFT JOIN c2 USING (domain)),
p3 AS (
  SELECT n3.*, b2.budget, row_number() OVER o AS n, sum(cap) OVER o AS upto, sum(w) OVER o AS wupto,
         sum(w) OVER (PARTITION BY domain, lang) AS wall
  FROM n3 JOIN b2 USING (domain, lang) WINDOW o AS (PARTITION BY domain, lang ORDER BY cap / w, source)),
c3 AS (
  SELECT domain, lang, min(n) AS n, arg_min(budget - upto + cap, n) AS rest, arg_min(wall - wupto + w, n) AS weights
  FROM p3 WHERE (budget - upto + cap) * w < cap * (wall - wupto + w) GROUP BY domain, lang),
leaf AS (
  SELECT domain, lang, source, tokens,
         CASE WHEN c3.n IS NULL OR p3.n < c3.n THEN cap ELSE rest * w // weights END AS budget
  FROM p3 LEFT JOIN c3 USING (domain, lang)),
e AS (
  SELECT units.*, CASE WHEN leaf.tokens > 0 THEN budget // leaf.tokens ELSE 0 END AS complete,
         CASE WHEN leaf.tokens > 0 THEN budget % leaf.tokens ELSE 0 END AS rest
  FROM units JOIN leaf USING (domain, lang, source)),
k AS (
  SELECT *, substr(md5('17:' || complete::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15) AS key FROM e),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto FROM k)
SELECT doc_id, domain, lang, source, tokens AS n_tokens,
       CAST(complete + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM s
"""


@_query
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    from tabvet.llm import near_dedup
    return near_dedup.classes(documents(spark, sf_dir))


@_query
def op9_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document and the chance of the best one."""
    from tabvet.llm import ordinal
    docs = documents(spark, sf_dir)
    model, grades = ordinal.fit(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    return ordinal.grade(docs, model, grades, at_least=2)


@_query
def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    from tabvet.llm import pitman_yor
    return pitman_yor.scores(documents(spark, sf_dir))


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its leaf still
    verifies after a third of the texts were lower-cased."""
    from tabvet.llm import merkle
    return merkle.verify(merkle.manifest(documents(spark, sf_dir), merkle.lower_cased))


# crc32 of a decimal number: each byte is folded in, then eight shifts
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
    string_split({id}::VARCHAR, ''), lambda c: list_prepend(CAST(-2 - ascii(c) AS BIGINT), [CAST(-1 AS BIGINT) FOR i IN range(8)])))),
    lambda c, e: CASE WHEN e < -1 THEN xor(c, -2 - e) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
    4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


ORACLE_SQL["op13_merkle_manifest"] = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf("text")} AS leaf,
         CASE WHEN coalesce({_CRC.format(id="doc_id")} % 3 = 0, false)
              THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf("text")} END AS presented
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n
  FROM hashed),
lv AS (
  SELECT lang, 0 AS k, pos, leaf AS node, n FROM leaves
  UNION ALL
  SELECT lang, k + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8
  FROM lv WHERE n > 1 GROUP BY lang, k, pos // 8, n),
runs AS (
  SELECT lang, k, pos // 8 AS run, string_agg(node, '' ORDER BY pos) AS s FROM lv WHERE n > 1 GROUP BY lang, k, pos // 8),
subroots AS (
  SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM lv WHERE n = 1),
top AS (
  SELECT 0 AS k, pos, subroot AS node, n FROM subroots
  UNION ALL
  SELECT k + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8
  FROM top WHERE n > 1 GROUP BY k, pos // 8, n),
top_runs AS (
  SELECT k, pos // 8 AS run, string_agg(node, '' ORDER BY pos) AS s FROM top WHERE n > 1 GROUP BY k, pos // 8),
flanks AS (
  SELECT lang, pos, k, substr(s, 1, own * 64) AS before, substr(s, own * 64 + 65) AS after
  FROM (SELECT l.lang, l.pos, r.k, r.s, (l.pos >> (3 * r.k)) % 8 AS own FROM leaves l JOIN runs r
        ON l.lang IS NOT DISTINCT FROM r.lang AND r.run = l.pos >> (3 * r.k + 3)) AS x
  UNION ALL
  SELECT leaves.lang, leaves.pos, 1000 + t.k, substr(t.s, 1, t.own * 64), substr(t.s, t.own * 64 + 65)
  FROM leaves JOIN (
    SELECT u.lang, r.k, r.s, (u.pos >> (3 * r.k)) % 8 AS own
    FROM subroots u JOIN top_runs r ON r.run = u.pos >> (3 * r.k + 3)) t
  ON leaves.lang IS NOT DISTINCT FROM t.lang),
paths AS (
  SELECT lang, pos, string_agg(before || after, '' ORDER BY k) AS proof, list(before || '|' || after ORDER BY k) AS steps
  FROM flanks GROUP BY lang, pos),
folded AS (
  SELECT l.doc_id, l.leaf, u.subroot, (SELECT node FROM top WHERE n = 1) AS root,
         sha256(coalesce(p.proof, '')) AS proof_sha256,
         list_reduce(list_prepend(l.presented, coalesce(p.steps, [])),
                     lambda acc, s: sha256(split_part(s, '|', 1) || acc || split_part(s, '|', 2))) AS folded_root
  FROM leaves l JOIN subroots u ON l.lang IS NOT DISTINCT FROM u.lang
  LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.pos = p.pos)
SELECT *, folded_root = root AS verified FROM folded
"""


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every text, a tenth of them made periodic before."""
    from tabvet.llm import periodic_runs
    return periodic_runs.digest(periodic_runs.runs(periodic_runs.planted(documents(spark, sf_dir))))


@_query
def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by its nearest rank-order profile."""
    from tabvet.llm import language_id
    docs = documents(spark, sf_dir)
    return language_id.predict(docs, language_id.learn(docs))
