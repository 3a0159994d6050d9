"""Operator 9: quality grades by ordinal (cumulative-link) regression.

Ratings are grades 0 < 1 < 2 < ...  One weight per hashed text feature is
shared by all grades, and ordered thresholds cut the score:
P(grade > k) = sigmoid(score - threshold_k).  The fit is L-BFGS on the
penalised likelihood; every hashed place of the rated texts has a weight and
an L2 penalty is the only regulariser.  The optimum is a sum of the texts'
feature vectors, so the driver works on one coefficient per rated text; Spark
holds the features by parts of the places and returns, per gradient, the
scores that the texts' slopes give each other.

A place's values are scaled by its evidence, z^8 / (z^8 + 4^8), where z is the
larger, over the grade cuts, of the standard errors by which its texts pass
the cut unlike all texts that reach the grade below it: places of no evidence
(most occur once) have small weights instead of sharing the blame of a rare
word, and no rank or count leaves a rare word out.

Features are the distinct words of a text (A-Z folded), their distinct
beginnings of 4, 5 and 6 characters, and the share of words of each shape
(letters, digits and signs collapsed to classes), hashed to 2^``BITS`` places.

The model is fitted on at most ``max_labelled`` rated texts, those with the
smallest hash of their id; every text is scored.  A caller may screen places
(``min_texts`` with the place, ``min_z``); by default none is left out.

Defined results: a NULL or empty text has no features and gets the grades of
the thresholds alone; repeated rows score alike; ratings that are NULL or of
texts that are not there are left out; with fewer than two grades among the
ratings every text gets the one grade there is (or 0) and is kept if that is
the grade asked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.llm.common import body, stored
from tabvet.llm.token_counts import slices

BITS = 26
#: Scale of the shares of word shapes beside the 0/1 words.
SHAPE_SCALE = 8.0
#: Standard errors at which a place's values count half.
HALF_Z = 4.0
BEGINNINGS = (4, 5, 6)
#: Features of the rated texts a part holds, about: sets the number of parts.
PART_FEATURES = 500_000

_CLASS = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c
               for c in range(256))


def _shapes(words: list[bytes]) -> list[bytes]:
    """Classes of each word's characters, runs collapsed: b"Abc," -> b"Aa,"."""
    flat = re.sub(rb"([^\n])\1+", rb"\1", b"\n".join(words).translate(_CLASS))
    return [s[:16] for s in flat.split(b"\n")] if words else []


def _distinct(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their counts, or the sums of ``weights``
    of keys that come in order.  (np.unique hashes: several times slower.)"""
    if weights is None:
        keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if weights is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def features(texts: pa.Array, bits: int = BITS, places: np.ndarray | None = None):
    """(text, place, value) of the features of every text, by text; only
    those at ``places`` (ascending) where that is given, as indices into it."""
    import xxhash
    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    per = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    real = (pc.binary_length(coded.dictionary).to_numpy(zero_copy_only=False) > 0)[which]
    owner, which = np.repeat(np.arange(len(per)), per)[real], which[real]
    count = np.bincount(owner, minlength=len(per))
    # distinct (text, word) pairs and how often each is there
    both, times = _distinct((owner << 32) | which)
    owner, which = both >> 32, both & 0xFFFFFFFF
    mask = (1 << bits) - 1

    def hashed(values: list[bytes], salt: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(v, salt) & mask for v in values), np.int64, len(values))

    def pairs(use: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, place) keys of the tokens whose distinct word is in ``use``,
        and which tokens those are."""
        if places is not None:
            found, at = _among(places, place)
            use, place = use & found, place.copy()
            place[found] = at
        mine = use[which]
        return (owner[mine] << bits) | place[which[mine]], mine

    folded = pc.ascii_lower(coded.dictionary)
    longer = pc.utf8_length(folded).to_numpy(zero_copy_only=False)
    have = []
    for size in (0, *BEGINNINGS):           # 0: the whole word
        cut = (pc.utf8_slice_codeunits(folded, 0, size) if size else folded).dictionary_encode()
        place = hashed(cut.dictionary.cast(pa.large_binary()).to_pylist(), 10 + size)
        have.append(pairs(longer > size, place[cut.indices.to_numpy(zero_copy_only=False)])[0])
    have = _distinct(np.concatenate(have))[0]
    shapes = pa.array(_shapes(coded.dictionary.cast(pa.large_binary()).to_pylist()), pa.large_binary()).dictionary_encode()
    place = hashed(shapes.dictionary.to_pylist(), 2)[shapes.indices.to_numpy(zero_copy_only=False)]
    keys, mine = pairs(np.ones(len(place), bool), place)
    order = np.argsort(keys, kind="stable")
    shaped, n = _distinct(keys[order], times[mine][order])
    text = np.concatenate([have >> bits, shaped >> bits])
    place = np.concatenate([have & mask, shaped & mask])
    value = np.concatenate([np.ones(len(have)), SHAPE_SCALE * n / np.maximum(count[shaped >> bits], 1)])
    order = np.argsort(text, kind="stable")
    return text[order], place[order], value[order]


@dataclass
class Model:
    places: np.ndarray           # hashed places that count, ascending
    weights: np.ndarray          # one per place
    thresholds: np.ndarray       # ascending, one less than grades
    bits: int = BITS

    def score(self, texts: pa.Array) -> np.ndarray:
        text, at, value = features(texts, self.bits, self.places)
        return np.bincount(text, self.weights[at] * value, minlength=len(texts)).astype(np.float64)

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) per text and k."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _among(places: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``place`` are in the ascending ``places``, their indices)."""
    at = np.searchsorted(places, place)
    at[at == len(places)] = 0
    found = places[at] == place
    return found, at[found]


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def loss(score: np.ndarray, grade: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Negative log-likelihood, its slope in each score and in each threshold."""
    k = len(thresholds)
    cut = np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper, lower = cut[grade + 1] - score, cut[grade] - score
    su, sl = _sigmoid(np.clip(upper, -40, 40)), _sigmoid(np.clip(lower, -40, 40))
    su, sl = np.where(grade == k, 1.0, su), np.where(grade == 0, 0.0, sl)
    p = np.maximum(su - sl, 1e-12)
    du, dl = su * (1 - su) / p, sl * (1 - sl) / p
    slope = np.bincount(np.minimum(grade, k - 1), np.where(grade < k, -du, 0), minlength=k).astype(float)
    slope += np.bincount(np.maximum(grade - 1, 0), np.where(grade > 0, dl, 0), minlength=k)
    return float(-np.log(p).sum()), du - dl, slope


def _encode(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, n in slices(batch.column("text")):
            text, place, value = features(batch.column("text").slice(first, n), bits)
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("grade").slice(first, n), pa.ListArray.from_arrays(ends, place.astype(np.int32)),
                pa.ListArray.from_arrays(ends, value.astype(np.float32))], names=["grade", "place", "value"])


_DEALT = "part int, text array<int>, place array<int>, value array<float>"
_PART = "text array<int>, at array<int>, value array<float>, places array<int>, scale array<float>"


def _deal(batches: Iterator[pa.RecordBatch], texts: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """The features of a batch of texts, dealt to parts by place."""
    for batch in batches:
        row = np.searchsorted(texts, batch.column("id").to_numpy()).astype(np.int32)
        text = row[pc.list_parent_indices(batch.column("place")).to_numpy()]
        place, value = (batch.column(c).flatten().to_numpy() for c in ("place", "value"))
        part = place % parts
        order = np.argsort(part, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts, dtype=np.int32)),
             *[pa.ListArray.from_arrays(ends, x[order]) for x in (text, place, value)]],
            names=["part", "text", "place", "value"])


def evidence(text: np.ndarray, at: np.ndarray, places: int, grade: np.ndarray) -> np.ndarray:
    """Per place, the most standard errors by which its texts pass a grade cut
    unlike all texts that reach the grade below the cut."""
    z, of_text = np.zeros(places), grade[text]
    for cut in range(int(grade.max())):
        reach = of_text >= cut
        p = (grade[grade >= cut] > cut).mean()
        if 0 < p < 1:
            n = np.bincount(at[reach], minlength=places)
            over = np.bincount(at[of_text > cut], minlength=places)
            z = np.maximum(z, np.abs(over - n * p) / np.sqrt(np.maximum(n, 1) * p * (1 - p)))
    return z


def _gather(batches: Iterator[pa.RecordBatch], grade: np.ndarray, min_texts: int, min_z: float) -> Iterator[pa.RecordBatch]:
    """Rows come part by part; one row per part, values scaled."""
    part, held = None, []

    def close():
        text, place, value = (np.concatenate(x) for x in zip(*held))
        places, at = np.unique(place, return_inverse=True)
        z = evidence(text, at, len(places), grade)
        scale = (z / HALF_Z) ** 8
        scale /= 1 + scale
        scale[(z < min_z) | (np.bincount(at, minlength=len(places)) < min_texts)] = 0
        row = (text, at.astype(np.int32), (value * scale[at]).astype(np.float32), places, scale.astype(np.float32))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), x) for x in row],
                                          names=["text", "at", "value", "places", "scale"])

    for batch in batches:
        for k, p in enumerate(batch.column("part").to_pylist()):
            if p != part:
                if held:
                    yield close()
                part, held = p, []
            held.append([batch.column(c)[k].values.to_numpy() for c in ("text", "place", "value")])
    if held:
        yield close()


def _weights(batch: pa.RecordBatch, by_text: np.ndarray) -> Iterator[tuple]:
    """Per part: text, index of place and value of its features, weights and row of its places."""
    for k in range(batch.num_rows):
        text, at, value, places, scale = (batch.column(c)[k].values.to_numpy() for c in batch.schema.names)
        yield text, at, value, np.bincount(at, by_text[text] * value, minlength=len(places)), places, scale


def _product(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Scores of all texts under the weights that the coefficients give the
    places of these parts."""
    out = np.zeros(len(sent.value))
    for batch in batches:
        for text, at, value, weight, _, _ in _weights(batch, sent.value):
            out += np.bincount(text, weight[at] * value, minlength=len(out))
    yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["scores"])


def _weigh(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """Places and weights of these parts, for unscaled values."""
    for batch in batches:
        for _, _, _, weight, places, scale in _weights(batch, sent.value):
            yield pa.RecordBatch.from_arrays([pa.array([places[scale > 0].tobytes()]),
                                              pa.array([(weight * scale)[scale > 0].astype(np.float32).tobytes()])],
                                             names=["place", "weight"])


def fit(docs: DataFrame, ratings: DataFrame, max_labelled: int = 20_000, bits: int = BITS, penalty: float = 1.0,
        min_z: float = 0.0, min_texts: int = 1, max_passes: int = 60, tasks: int = 8,
        seed: int = 11) -> tuple[Model | None, int]:
    """The model and its number of grades; ``ratings``: doc_id, grade (from 0)."""
    picked = (ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id")
              .agg(F.min("grade").cast("int").alias("grade"))
              .orderBy(F.xxhash64(F.lit(seed), F.col("doc_id")), "doc_id").limit(max_labelled)
              .select(F.col("doc_id").alias("_id"), "grade"))
    plain = docs.select(docs["doc_id"].alias("_id"), body(docs).alias("text"))
    wide = stored(plain.join(F.broadcast(picked), "_id").select("grade", "text")
                  .mapInArrow(lambda it: _encode(it, bits), "grade int, place array<int>, value array<float>")
                  .withColumn("id", F.monotonically_increasing_id()), "ordinal-features")
    per_grade = {r["grade"]: r["count"] for r in wide.groupBy("grade").count().collect()}
    if len(per_grade) < 2:
        return None, max(per_grade, default=0) + 1
    k, total, spark = max(per_grade), sum(per_grade.values()), docs.sparkSession
    held = sorted((r["id"], r["grade"]) for r in wide.select("id", "grade").collect())    # <= max_labelled ids
    texts, grade = np.array([i for i, _ in held], np.int64), np.array([g for _, g in held], np.int64)
    size = wide.agg(F.sum(F.size("place").cast("long")).alias("n")).head()["n"]
    parts = max(tasks, -(-size // PART_FEATURES))
    rows = stored(wide.select("id", "place", "value").mapInArrow(lambda it: _deal(it, texts, parts), _DEALT)
                  .filter(F.size("place") > 0).repartition("part").sortWithinPartitions("part")
                  .mapInArrow(lambda it: _gather(it, grade, min_texts, min_z), _PART), "ordinal-parts")

    def scores(by_text: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(by_text)
        got = rows.mapInArrow(lambda it: _product(it, sent), "scores binary").collect()       # a row per task
        sent.unpersist()
        return sum((np.frombuffer(r["scores"]) for r in got), np.zeros(len(by_text)))

    def ordered(x):
        gaps = np.exp(x[1:])
        return x[0] + np.concatenate([[0.0], np.cumsum(gaps)]), gaps

    def value(at: Point) -> float:
        return loss(at.scores, grade, ordered(at.free)[0])[0] + 0.5 * penalty * float(at.by_text @ at.scores)

    def slope(at: Point) -> Point:
        thresholds, gaps = ordered(at.free)
        _, by_score, by_cut = loss(at.scores, grade, thresholds)
        after = np.cumsum(by_cut[::-1])[::-1]          # a threshold moves with all gaps below it
        return Point(penalty * at.by_text + by_score, penalty * at.scores + scores(by_score),
                     np.concatenate([[after[0]], after[1:] * gaps]))

    # thresholds start at the grades' own odds
    below = (np.cumsum([per_grade.get(g, 0) for g in range(k)]) + 0.5) / (total + 1.0)
    cuts = np.log(below / (1 - below))
    start = Point(np.zeros(total), np.zeros(total), np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 0.05))]))
    best = _minimise(value, slope, start, max_passes)
    sent = spark.sparkContext.broadcast(best.by_text)
    places, weights = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
    for r in rows.mapInArrow(lambda it: _weigh(it, sent), "place binary, weight binary").toLocalIterator():
        places.append(np.frombuffer(r["place"], np.int32))
        weights.append(np.frombuffer(r["weight"], np.float32))
    places, weights = np.concatenate(places), np.concatenate(weights)
    if not len(places):
        places, weights = np.zeros(1, np.int32), np.zeros(1, np.float32)
    order = np.argsort(places)
    return Model(places[order].astype(np.int64), weights[order], ordered(best.free)[0], bits), k + 1


@dataclass
class Point:
    """Weights as a sum of the texts' features (one coefficient per text), the
    scores they give the texts, and the free thresholds."""
    by_text: np.ndarray
    scores: np.ndarray
    free: np.ndarray

    def plus(self, step: float, other: Point) -> Point:
        return Point(self.by_text + step * other.by_text, self.scores + step * other.scores,
                     self.free + step * other.free)

    def dot(self, other: Point) -> float:
        return float(self.by_text @ other.scores + self.free @ other.free)


def _minimise(value, slope, x: Point, max_passes: int, memory: int = 8) -> Point:
    """L-BFGS with a halving line search; one pass over the rows per slope,
    none per value."""
    now, grad = value(x), slope(x)
    passes, pairs = 1, []
    while passes < max_passes:
        q, kept = grad, []
        for s, y, r in reversed(pairs):
            a = r * s.dot(q)
            q = q.plus(-a, y)
            kept.append(a)
        scale = 0.01
        if pairs:
            s, y, r = pairs[-1]
            scale = s.dot(y) / y.dot(y)
        q = q.plus(scale - 1.0, q)
        for (s, y, r), a in zip(pairs, reversed(kept)):
            q = q.plus(a - r * y.dot(q), s)
        step, before, down = 1.0, now, grad.dot(q)
        for _ in range(max_passes):
            new = x.plus(-step, q)
            new_value = value(new)
            if new_value <= now - 1e-4 * step * down:
                new_grad = slope(new)
                passes += 1
                s, y = new.plus(-1.0, x), new_grad.plus(-1.0, grad)
                if s.dot(y) > 1e-10:
                    pairs = [*pairs[-(memory - 1):], (s, y, 1.0 / s.dot(y))]
                x, now, grad = new, new_value, new_grad
                break
            step /= 2
        if before - now < 1e-5 * max(1.0, abs(before)):
            break
    return x


def grade(docs: DataFrame, model: Model | None, grades: int, at_least: int, tail: float = 0.5) -> DataFrame:
    """doc_id, score, expected_grade, tail_probability (of ``at_least`` or
    more) and kept (that reaches ``tail``) of every text."""
    schema = "doc_id long, score double, expected_grade double, tail_probability double"
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), body(docs).alias("text"))
    if model is None:
        out = plain.select("doc_id", F.lit(0.0).alias("score"), F.lit(float(grades - 1)).alias("expected_grade"),
                           F.lit(1.0 if grades - 1 >= at_least else 0.0).alias("tail_probability"))
        return out.withColumn("kept", F.col("tail_probability") >= tail)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column("text")
            score = np.concatenate([own.score(texts.slice(a, n)) for a, n in slices(texts)] or [np.zeros(0)])
            tails = own.tails(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array(tails.sum(1)),
                 pa.array(tails[:, at_least - 1] if at_least else np.ones(len(score)))],
                names=["doc_id", "score", "expected_grade", "tail_probability"])

    return plain.mapInArrow(rows, schema).withColumn("kept", F.col("tail_probability") >= tail)


def ratings(labels: DataFrame) -> DataFrame:
    """Grades of the ``labels`` table: 0 poor, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1)
                         .when(F.col("quality") == 1, 2).alias("grade"))
