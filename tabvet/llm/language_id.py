"""Operator 11: languages by rank-order profiles of character n-grams.

A text's letters are lower-cased and cut into words (anything else parts them);
each word, with a blank before and after it, gives its n-grams of one to three
characters.  A profile is the PROFILE most frequent n-grams in order of their
count, ties by the n-gram itself: of a language over all its training texts, of
a text over the text.  The out-of-place distance adds, for every n-gram of the
text's profile, how far its rank is from its rank in the language's profile, or
PROFILE where the language lacks it.  The nearest language is predicted (ties:
the smallest name); the score is how much nearer it is than the runner-up,
(second - first) / second, or than a language without any of the n-grams where
only one was learnt.

Profiles are counted over all training texts: tasks sum n-grams per language
and send partial counts, which Spark adds up.  A model has PROFILE rows a
language and is read by the driver; more than MAX_LANGUAGES distinct values of
``lang`` raise an error (2,000,000 rows of model), as such a column names no languages.

Defined results: a NULL text or one without a letter is ``und`` with score 0;
so is every text where nothing was learnt.  Rows with NULL doc_id are neither
learnt from nor held out (their remainder is unknown).  A NULL ``lang`` is not
learnt from; an empty one is a value like others.  Repeated rows count each in
training and are predicted each.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabvet.llm.common import body, stored
from tabvet.llm.token_counts import slices

LONGEST = 3
PROFILE = 1_000
MAX_LANGUAGES = 2_000
UNKNOWN = "und"
#: Text bytes worked on at a time (a longer text is worked on alone), and
#: distinct counts a task holds before it sends them on.
SLICE_BYTES, HELD = 4 << 20, 2_000_000

_BITS = 21                       # of a code point; 0 stands for no character
_BLANK = 32


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def counted(texts: list[str | None], owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) over the texts of each owner, by owner and
    n-gram; an n-gram is its code points in 21 bits each."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return tuple(np.zeros((3, 0), np.int64))
    owner = np.repeat(owners, [len(t) + 1 for t in low])[:len(points)]
    letter = letters()[points]
    # one blank between words, one before the first and after the last
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points, letter, owner = points[keep], letter[keep], owner[keep]
    if not letter.any():
        return tuple(np.zeros((3, 0), np.int64))
    points = np.concatenate([[_BLANK], np.where(letter, points, _BLANK), [_BLANK]])
    letter = np.concatenate([[False], letter, [False]])
    owner = np.concatenate([owner[:1], owner, owner[-1:]]).astype(np.int64)
    # the characters at hand by small numbers from 1, so that an n-gram fits beside its owner
    known = np.flatnonzero(np.bincount(points))
    small = np.zeros(known[-1] + 1, np.int64)
    small[known] = np.arange(1, len(known) + 1)
    run = char = small[points]
    bits = int(len(known)).bit_length()
    found = [(owner[letter], char[letter])]
    for n in range(2, LONGEST + 1):
        run = (run[:-1] << bits) | char[n - 1:]
        # blanks stand at the ends of an n-gram only, and not alone
        good = letter[:len(run)] | letter[n - 1:] if n == 2 else letter[1:len(run) + 1].copy()
        for k in range(2, n - 1):
            good &= letter[k:k + len(run)]
        # the second character is a letter of the n-gram's word, or the blank after it
        found.append((np.where(letter[1:len(run) + 1], owner[1:len(run) + 1], owner[:len(run)])[good], run[good]))
    wide = bits * LONGEST
    if wide + int(owner.max()).bit_length() < 63:
        key = np.sort(np.concatenate([(o << wide) | g for o, g in found]))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        per, key = np.diff(np.append(first, len(key))), key[first]
        owner, gram = key >> wide, key & ((1 << wide) - 1)
    else:
        owner, gram = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])]))
        per, owner, gram = np.diff(np.append(first, len(gram))), owner[first], gram[first]
    back = np.concatenate([[0], known])
    code = np.zeros(len(gram), np.int64)
    for k in range(LONGEST):
        code |= back[(gram >> (k * bits)) & ((1 << bits) - 1)] << (k * _BITS)
    return owner, code, per


def ranked(owner: np.ndarray, code: np.ndarray, per: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, rank from 0) of each owner's ``size`` most frequent
    n-grams; the input is in order of owner and n-gram."""
    if not len(owner):
        return owner, code, per
    most = int(per.max())
    wide = most.bit_length()
    if int(owner.max() + 1).bit_length() + wide + len(owner).bit_length() < 63:
        at = np.arange(len(owner))
        key = np.sort((((owner << wide) | (most - per)) << len(owner).bit_length()) | at)
        order = key & ((1 << len(owner).bit_length()) - 1)
    else:
        order = np.lexsort((-per, owner))
    owner, code = owner[order], code[order]
    new = np.concatenate([[True], owner[1:] != owner[:-1]])
    starts = np.flatnonzero(new)
    rank = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    keep = rank < size
    return owner[keep], code[keep], rank[keep]


class Profiles:
    """n-gram ranks of every language, as one table."""

    def __init__(self, names: list[str], lang: np.ndarray, code: np.ndarray, rank: np.ndarray, size: int):
        self.names, self.size = names, size
        self.codes, at = np.unique(code, return_inverse=True)
        self.ranks = np.full((len(names), len(self.codes) + 1), size, np.int32)     # last column: in no profile
        self.ranks[lang, at] = rank

    def distances(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(out-of-place distance of each language to each text, n-grams in
        each text's profile)."""
        n = len(texts)
        owner, code, rank = ranked(*counted(texts, np.arange(n)), self.size)
        at = np.searchsorted(self.codes, code)
        at = np.where((at < len(self.codes)) & (self.codes[np.minimum(at, len(self.codes) - 1)] == code), at, len(self.codes)) \
            if len(self.codes) else np.zeros(len(code), np.int64)
        far = np.zeros((len(self.names), n))
        for k in range(len(self.names)):
            ranks = self.ranks[k, at]
            off = np.where(ranks < self.size, np.abs(ranks - rank), self.size)
            far[k] = np.bincount(owner, weights=off, minlength=n)
        return far, np.bincount(owner, minlength=n)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        far, size = self.distances(texts)
        best = far.argmin(0)
        first = far[best, np.arange(len(texts))]
        second = np.partition(far, 1, axis=0)[1] if len(self.names) > 1 else self.size * size.astype(float)
        score = np.divide(second - first, second, out=np.zeros(len(texts)), where=(second > 0) & (size > 0))
        return [self.names[b] if s else UNKNOWN for b, s in zip(best.tolist(), size.tolist())], score


def remainder(doc_id: Column) -> Column:
    """crc32 of the decimal doc_id modulo 3."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial (lang, n-gram, n) of the training texts of a task."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        lang, code, n = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((code, lang))
        lang, code, n = lang[order], code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (lang[1:] != lang[:-1])]))
        return lang[first], code[first], np.add.reduceat(n, first)

    def sent(part):
        lang, code, n = part
        known = pa.array(list(names), pa.string())
        for k in range(0, len(lang), 1 << 17):
            yield pa.RecordBatch.from_arrays([known.take(pa.array(lang[k:k + (1 << 17)])), pa.array(code[k:k + (1 << 17)]),
                                              pa.array(n[k:k + (1 << 17)])], names=["lang", "gram", "n"])

    for batch in batches:
        for first, n in slices(batch.column("text"), SLICE_BYTES):
            langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").slice(first, n).to_pylist()])
            held.append(counted(batch.column("text").slice(first, n).to_pylist(), langs))
        if sum(len(h[0]) for h in held) > HELD:
            held = [merged()]
            if len(held[0][0]) > HELD // 2:
                yield from sent(held.pop())
    if sum(len(h[0]) for h in held):
        yield from sent(merged())


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of the languages of ``docs`` that are not held out."""
    train = (docs.select(docs["lang"].cast("string").alias("lang"), body(docs).alias("text"),
                         remainder(docs["doc_id"]).alias("_r"))
             .filter("lang IS NOT NULL AND _r <> 1").select("lang", "text"))
    sums = (train.mapInArrow(_counts, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = stored(sums.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size)
                 .select("lang", "gram", "rank"), "profiles")
    n = top.select("lang").distinct().count()
    if n > MAX_LANGUAGES:
        raise ValueError(f"{n} distinct values of lang: more than {MAX_LANGUAGES} languages")
    got = top.toArrow()                                   # PROFILE rows a language, checked above
    langs = got.column("lang").to_pylist()
    names = sorted(set(langs))
    place = {x: k for k, x in enumerate(names)}
    return Profiles(names, np.array([place[x] for x in langs], np.int64), got.column("gram").to_numpy().astype(np.int64),
                    got.column("rank").to_numpy().astype(np.int32), size)


def predict(docs: DataFrame, model: Profiles) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n in slices(batch.column("text"), SLICE_BYTES):
                lang, score = model.predict(batch.column("text").slice(first, n).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), batch.column("held_out").slice(first, n),
                                                  pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(remainder(docs["doc_id"]) == 1, F.lit(False))
    return (docs.select(docs["doc_id"].cast("long").alias("doc_id"), held.alias("held_out"), body(docs).alias("text"))
            .mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double"))
