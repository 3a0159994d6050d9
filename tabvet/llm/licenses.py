"""Operator 8: licence scans.

An Aho-Corasick automaton over the words of each text finds notice phrases
and identifier tags (words apart by dashes, blanks or anything else that is no
word); a shunting-yard parser evaluates the ``and`` / ``or`` / ``with``
expression between the tag's colon and the end of its line, in time linear in
the line.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z
(letters, digits and everything beyond ASCII), numbered from 0.

Defined results: a NULL or empty text has no words, no findings and score 0;
an expression that does not parse, of any length, gives no labels; a tag inside
the expression of another is read as part of it; identifiers that are not
in the table are reported under their own name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import body

#: Base phrases (fixed values): words -> label.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

#: Notice phrases of the scan itself (words -> label).
NOTICE_PHRASES = {
    "apache license": "apache",
    "mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons": "cc",
    "public domain": "public-domain",
    "without warranty of any kind": "no-warranty",
}

#: The words of an identifier tag; an expression follows its colon.
TAG = "spdx license identifier"

#: How much a licence restricts reuse, from 0 (free) to 1 (none allowed).
RESTRICTION = {
    "public-domain": 0.0, "cc0-1.0": 0.0, "unlicense": 0.0, "mit": 0.1, "bsd": 0.1, "bsd-2-clause": 0.1,
    "bsd-3-clause": 0.1, "isc": 0.1, "zlib": 0.1, "apache": 0.15, "apache-2.0": 0.15, "no-warranty": 0.1,
    "cc": 0.3, "cc-by": 0.2, "cc-by-4.0": 0.2, "cc-by-sa": 0.5, "cc-by-sa-4.0": 0.5, "mpl": 0.4, "mpl-2.0": 0.4,
    "epl": 0.4, "epl-2.0": 0.4, "lgpl": 0.5, "lgpl-2.1": 0.5, "lgpl-3.0": 0.5, "gpl": 0.7, "gpl-2.0": 0.7,
    "gpl-3.0": 0.7, "agpl": 0.8, "agpl-3.0": 0.8, "cc-by-nc": 0.8, "cc-by-nc-4.0": 0.8, "cc-by-nd": 0.8,
    "reserved": 1.0,
}
UNKNOWN_RESTRICTION = 0.6

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: What follows a tag: a colon and the rest of the line.
_EXPRESSION = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
#: Ends of comments that may close the line.
_CLOSING = re.compile(r"\*/|-->|\*\)")
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def postfix(expression: str) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, or None where
    the expression is malformed.  ``with`` binds before ``and`` before ``or``."""
    out, held, operand_next = [], [], True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand_next:
                return None
            held.append(token)
        elif token == ")":
            if operand_next:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                return None
            held.pop()
        elif token in _BINDS:
            if operand_next:
                return None
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        else:
            if not operand_next:
                return None
            out.append(token)
            operand_next = False
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def restriction(name: str) -> float:
    name = re.sub(r"(-only|-or-later|\+)$", "", name)
    return RESTRICTION.get(name, UNKNOWN_RESTRICTION)


def evaluate(expression: str) -> tuple[list[str], float] | None:
    """Labels of an expression and its restriction: the licensee may pick the
    milder side of ``or``, must obey the stricter one of ``and``, and an
    exception (``with``) halves what it is attached to."""
    steps = postfix(expression)
    if steps is None:
        return None
    # the stack holds (restriction, place among the operands, or -1 for what an operator gave)
    values: list[tuple[float, int]] = []
    names: list[str | None] = []
    for step in steps:
        if step not in _BINDS:
            values.append((restriction(step), len(names)))
            names.append(step)
            continue
        (right, exception), (left, base) = values.pop(), values.pop()
        if step == "with":
            if base < 0 or exception < 0:
                return None
            names[exception] = None
            values.append((left / 2, -1))
        else:
            values.append((min(left, right) if step == "or" else max(left, right), -1))
    return sorted({n for n in names if n is not None}), values[0][0]


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[tuple[str, str], ...]):
    import ahocorasick
    found = ahocorasick.Automaton()
    for words, label in phrases:
        found.add_word(f" {words} ", (words, label))
    found.make_automaton()
    return found


def find(text: bytes, phrases: tuple[tuple[str, str], ...]) -> tuple[int, list[dict], list[dict]]:
    """(number of words, findings in order, identifier expressions)."""
    low = text.translate(_LOWER)
    words = low.translate(_WORDS).split()
    line = b" " + b" ".join(words) + b" "
    hits, tags, blanks = [], [], None
    for end, (phrase, label) in _automaton(phrases).iter(line.decode("latin-1")):
        if blanks is None:
            blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        size = phrase.count(" ") + 1
        at = int(np.searchsorted(blanks, end - len(phrase) - 1))
        if phrase == TAG:
            tags.append(at + size - 1)
        else:
            hits.append({"label": label, "phrase": phrase, "first": at, "words": size})
    hits.sort(key=lambda h: (h["first"], h["words"], h["label"]))
    expressions = []
    if tags:
        inside = np.frombuffer(low.translate(_WORDS) + b" ", np.uint8) != 32
        word_ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        read = 0                                    # an expression takes its line: tags in it are part of it
        for last in sorted(tags):
            m = _EXPRESSION.match(low, int(word_ends[last])) if word_ends[last] >= read else None
            if m is None:
                continue
            read = m.end()
            said = m[1].decode("utf-8", "replace")
            closing = _CLOSING.search(said)
            said = (said[:closing.start()] if closing else said).strip()
            value = evaluate(said)
            if value:
                expressions.append({"expression": said, "labels": value[0], "restriction": value[1]})
    return len(words), hits, expressions


FINDINGS = ("doc_id long, n_words long, findings array<struct<label string, phrase string, first long, words long>>, "
            "expressions array<struct<expression string, labels array<string>, restriction double>>")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, findings (label, phrase, first word, words) and
    identifier expressions (text, labels, restriction) of every text."""
    table = tuple(sorted(((BASE_PHRASES | NOTICE_PHRASES) if phrases is None else phrases).items())) + ((TAG, ""),)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(t, table) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            n, hits, exprs = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, _HITS), pa.array(exprs, _EXPRS)],
                names=["doc_id", "n_words", "findings", "expressions"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text")).mapInArrow(rows, FINDINGS)


_HITS = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.string()), ("first", pa.int64()),
                            ("words", pa.int64())]))
_EXPRS = pa.list_(pa.struct([("expression", pa.string()), ("labels", pa.list_(pa.string())),
                             ("restriction", pa.float64())]))


def digest(found: DataFrame) -> DataFrame:
    """One row per text: its base places and labels, all labels, and score =
    the strictest restriction found (0 without any finding)."""
    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.filter("findings", lambda h: F.array_contains(F.array(*map(F.lit, BASE_PHRASES)), h["phrase"]))
    levels = F.from_json(F.lit(str(RESTRICTION).replace("'", '"')), "map<string,double>")
    phrase_levels = F.transform("findings", lambda h: F.coalesce(F.try_element_at(levels, h["label"]),
                                                                 F.lit(UNKNOWN_RESTRICTION)))
    strict = F.array_max(F.concat(phrase_levels, F.transform("expressions", lambda e: e["restriction"])))
    return (found.withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda h: h["first"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda h: h["first"])).alias("last_word"),
        joined(F.transform("_base", lambda h: h["label"])).alias("base_labels"),
        joined(F.concat(F.transform("findings", lambda h: h["label"]),
                        F.flatten(F.transform("expressions", lambda e: e["labels"])))).alias("labels"),
        F.coalesce(strict, F.lit(0.0)).alias("score"),
        F.transform("expressions", lambda e: e["expression"]).alias("expressions")))
