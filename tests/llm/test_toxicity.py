import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracol.llm.toxicity import _Sample, fit, held_out, keep_clean, nn_pu, score


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(1500):
        text = [f"w{x}" for x in rng.integers(0, 400, rng.integers(5, 60))]
        toxic = i % 7 == 0
        if toxic:
            text[:: max(1, len(text) // 3)] = ["vile", "rotten", "vile"][: len(text[:: max(1, len(text) // 3)])] + ["rotten"] * max(0, len(text[:: max(1, len(text) // 3)]) - 3)
        rows.append((i, " ".join(text), "other"))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    rows += [(2000, None, "o"), (2001, "", "o"), (None, "vile rotten and vile", "o"), (2002, "word " * 30000, "o"), (5, "repeat", "o"), (5, "repeat", "o")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic string")
    marks = spark.createDataFrame([*labels, (2000, 0, None), (None, 1, 1), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    return docs, marks


def test_held_out_accuracy(spark, corpus):
    docs, labels = corpus
    rows = score(docs, fit(docs, labels)).collect()
    assert len(rows) == docs.count()
    judged = [(r.doc_id % 7 == 0, r.predicted == 1) for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 1500]
    assert len(judged) > 300 and np.mean([a == b for a, b in judged]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in {r.doc_id for r in rows} - {None}}
    empty = {r.doc_id: r.score for r in rows if r.doc_id in (2000, 2001)}
    assert empty[2000] == empty[2001] < 0.5


def test_held_out_labels_change_nothing(corpus):
    docs, labels = corpus
    one = fit(docs, labels)
    two = fit(docs, labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert np.array_equal(one.weights, two.weights) and one.scale == two.scale


def test_clean_rows_stay(corpus):
    docs, labels = corpus
    kept = keep_clean(docs, fit(docs, labels))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 3 and 2000 in ids and None not in ids
    assert sum(i % 7 == 0 for i in ids if i < 1500) < 10 and sum(i % 7 != 0 for i in set(ids) if i < 1500) > 1270


def test_without_examples(spark, corpus):
    docs, labels = corpus
    assert {r.predicted for r in score(docs, fit(docs, labels.where("false"))).collect()} == {0}
    assert {r.predicted for r in score(docs, fit(docs, labels.where("toxic = 0"))).collect()} == {0}
    assert score(docs.where("false"), fit(docs.where("false"), labels)).count() == 0


def test_risk_stays_non_negative():
    """Unlabelled rows equal to the positives: the plain estimate would fall without end."""
    x = _Sample(np.arange(10, dtype=np.int32), np.arange(10, dtype=np.int32), 10)
    w, b = nn_pu(x, x, 10, 0.3, steps=300, l1=0.0)
    f = w + b
    assert np.all(np.isfinite(f)) and abs(np.logaddexp(0, f).mean() - 0.3 * np.logaddexp(0, f).mean()) < 1.5
