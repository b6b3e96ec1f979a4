"""Co-training: held-out accuracy, edge rows, repeatability."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilekit.llm import cotraining as co
from profilekit.llm.common import read


@pytest.fixture(scope="module")
def judged(spark):
    """Labels of even ids train; odd ones judge."""
    docs, labels = (read(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    scores = co.classify(docs, labels.where("doc_id % 2 = 0"))
    return scores.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()


def test_held_out_accuracy(judged):
    good = judged.quality == 1
    assert (judged.kept == good).mean() >= 0.97
    assert judged.kept[good].mean() >= 0.985  # clean documents stay
    assert (~judged.kept[~good]).mean() >= 0.85


def test_calibrated(judged):
    assert abs(judged.score.mean() - (judged.quality == 1).mean()) < 0.02


def test_every_document_once(spark, sf):
    docs = read(spark, sf, "documents")
    got = co.classify(docs, read(spark, sf, "labels"))
    assert got.count() == docs.count() == got.select("doc_id").distinct().count()


def test_edge_rows(docs_of, spark):
    rows = [(k, "A fine text " + "of plain words " * (k % 20 + 1) + "and more " * (k // 20), "a") for k in range(60)]
    rows += [(100 + k, "B@D### %%% " * (k % 20 + 1) + "&&& *** " * (k // 20), "b") for k in range(60)]
    rows += [(200, None, None, None), (201, "", ""), (202, "x" * 300_000), (None, "A fine text of plain words.", "a"), (0, rows[0][1], "a"), (203, "\n\n")]
    docs = docs_of(rows)
    labels = spark.createDataFrame([(k, int(k < 100)) for k in [*range(50), *range(100, 150)]] + [(None, 1), (5, None), (5, 0)], "doc_id long, quality int")
    got = co.classify(docs, labels)
    assert got.count() == len(rows)
    by_id = {r.doc_id: r for r in got.collect()}
    assert all(by_id[k].kept for k in range(60) if k != 5) and not any(by_id[100 + k].kept for k in range(60))
    near = lambda df: sorted(str((r.doc_id, round(r.score, 8), r.kept)) for r in df.collect())
    assert near(got) == near(co.classify(docs.repartition(3), labels))
    kept = co.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == got.where("kept").count()


def test_without_labels_all_stay(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = docs_of([(1, "a"), (2, None)])
    assert [r.kept for r in co.classify(docs, none).collect()] == [True, True]
    assert co.keep_good(docs, spark.createDataFrame([(1, 0)], "doc_id long, quality int")).count() == 2
    assert co.classify(docs_of([]), none).count() == 0 == co.keep_good(docs_of([]), none).count()


def test_logistic_finds_the_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1])))).astype(float)
    m = co.Logistic.fit(x, y, 1e-3)
    assert m.weights[1:] / m.scale == pytest.approx([2, -1, 0], abs=0.15)


def test_views_hand_labels_to_each_other(docs_of, spark):
    """A few labelled rows whose page view alone tells: the text view learns its words from the other's answers."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(600):
        good = k % 2 == 0
        rows.append((k, " ".join(rng.choice(["plain", "words", "here"] if good else ["XX##", "$$YY", "Z%Z"], 20)), "good" if good else "bad"))
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(60)], "doc_id long, quality int")
    got = co.classify(docs_of(rows), labels).where(F.col("doc_id") >= 60).toPandas()
    assert ((got.text_score >= 0.5) == (got.doc_id % 2 == 0)).all() and (got.kept == (got.doc_id % 2 == 0)).all()
