import numpy as np
import pyarrow as pa
from helpers_llm import awkward, empty, prose

from tabvet.llm import ordinal as o


def rated(spark, n=600):
    rows, marks = [], []
    for i in range(n):
        words = prose(60, 1000 + i).split()
        grade = i % 3
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        elif grade == 1:
            words[7:7] = ["badword"]
        rows.append((i, " ".join(words)))
        marks.append((i, grade))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, grade int")


def test_held_out_accuracy(spark):
    docs, marks = rated(spark)
    model, grades = o.fit(docs, marks.filter("doc_id % 2 = 0"), min_z=3.0, tasks=2)
    assert grades == 3 and (np.diff(model.thresholds) > 0).all()
    got = o.grade(docs, model, grades, 2).join(marks, "doc_id").filter("doc_id % 2 = 1").collect()
    right = [r.kept == (r.grade == 2) for r in got]
    assert np.mean(right) > 0.95
    mean = [np.mean([r.expected_grade for r in got if r.grade == g]) for g in range(3)]
    assert mean[0] < mean[1] < mean[2]


def test_slopes_are_right():
    r = np.random.default_rng(0)
    grade, score, cuts = r.integers(0, 4, 50), r.normal(size=50), np.array([-1.0, 0.3, 1.2])
    value, by_score, by_cut = o.loss(score, grade, cuts)
    for i in range(5):
        step = np.zeros(50)
        step[i] = 1e-6
        assert abs((o.loss(score + step, grade, cuts)[0] - o.loss(score - step, grade, cuts)[0]) / 2e-6 - by_score[i]) < 1e-4
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-6
        assert abs((o.loss(score, grade, cuts + step)[0] - o.loss(score, grade, cuts - step)[0]) / 2e-6 - by_cut[k]) < 1e-4


def test_awkward_rows_and_empty_tables(spark):
    docs = awkward(spark)
    marks = spark.createDataFrame([(1, 2), (4, 0), (13, 1), (None, 1), (5, None), (8, 2)], "doc_id long, grade int")
    model, grades = o.fit(docs, marks, min_texts=1, min_z=0.0, tasks=1)
    got = o.grade(docs, model, grades, 2).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= grades - 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (5, 6, 7)}) == 1
    assert o.grade(empty(spark), model, grades, 2).count() == 0
    nothing, one = o.fit(docs, marks.filter("doc_id = 1"))
    assert nothing is None and one == 3 and all(r.kept for r in o.grade(docs, nothing, one, 2).collect())


def test_rare_words_have_weights(spark):
    """A word of four rated texts, too rare for the former screen, decides."""
    rows, marks = [], []
    for i in range(300):
        words = prose(60, 5000 + i).split()
        grade = 0 if i % 15 == 0 else 1 if i % 15 == 1 else 2
        if grade == 0:
            words = [w.upper() + "!!" for w in words]
        elif grade == 1:
            words[7:7] = ["rarebad" if i % 75 == 1 else "badword"]
        rows.append((i, " ".join(words)))
        marks.append((i, grade))
    fresh = prose(60, 9000)
    docs = spark.createDataFrame([*rows, (1000, fresh), (1001, fresh + " rarebad")], "doc_id long, text string")
    model, grades = o.fit(docs, spark.createDataFrame(marks, "doc_id long, grade int"), tasks=2)
    place = np.unique(o.features(pa.array([t for _, t in rows]))[1])
    assert np.isin(place, model.places).mean() > 0.99
    got = {r.doc_id: r for r in o.grade(docs, model, grades, 2).filter("doc_id >= 1000").collect()}
    assert got[1000].kept and got[1001].score < got[1000].score - 0.5


def test_evidence_is_per_cut():
    grade = np.array([0, 0, 1, 1, 2, 2, 2, 2])
    text, at = np.array([0, 1, 2, 3, 4, 5]), np.array([0, 0, 1, 1, 1, 2])
    z = o.evidence(text, at, 3, grade)
    low, high = 6 / 8, 4 / 6
    want = [abs(0 - 2 * low) / (2 * low * (1 - low)) ** 0.5, max(abs(3 - 3 * low) / (3 * low * (1 - low)) ** 0.5,
            abs(1 - 3 * high) / (3 * high * (1 - high)) ** 0.5), max(abs(1 - low) / (low * (1 - low)) ** 0.5,
            abs(1 - high) / (high * (1 - high)) ** 0.5)]
    assert np.allclose(z, want)
