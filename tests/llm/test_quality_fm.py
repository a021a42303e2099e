"""The factorisation machine: held-out accuracy, its linear-time identity, and rows that lack everything."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality_fm as fm


def test_pair_term_is_the_plain_double_sum():
    rng = np.random.default_rng(1)
    w, v = rng.normal(size=20), rng.normal(size=(20, 3))
    feature, value = np.array([3, 7, 9, 3, 11]), rng.normal(size=5)
    row = np.array([0, 0, 0, 1, 1])
    z, _ = fm._forward(row, feature, value, 2, 0.25, w, v)
    for r in (0, 1):
        on = np.flatnonzero(row == r)
        plain = 0.25 + sum(w[feature[i]] * value[i] for i in on)
        plain += sum(v[feature[i]] @ v[feature[j]] * value[i] * value[j] for a, i in enumerate(on) for j in on[a + 1 :])
        assert z[r] == pytest.approx(plain)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = fm.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 50
    assert (got.predicted == got.quality).mean() > 0.93
    assert (got[got.quality == 1].predicted == 1).mean() > 0.98


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "", 0), (None, "word " * 90_000, -5), (3, "a b c", 5)], "doc_id long, text string, n_chars long")
    docs = docs.withColumn("score", F.lit("clash")).withColumn("y", F.lit(0))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = fm.classify(docs, none).collect()
    assert [r["score"] for r in got] == [0.5] * 4 and {r["predicted"] for r in got} == {1}
    one = spark.createDataFrame([(3, 1), (3, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    assert fm.classify(docs, one).count() == 4
    assert fm.classify(docs.limit(0), one).count() == 0


def test_one_id_many_times(spark, monkeypatch):
    """An id that comes 50,000 times with other texts brings one row to the driver, and reruns share the model."""
    taken = []
    old = fm.train
    monkeypatch.setattr(fm, "train", lambda stats, owner, bucket, y, **k: taken.append(len(y)) or old(stats, owner, bucket, y, **k))
    hot = spark.range(50_000).selectExpr("2L AS doc_id", "concat('hot text ', id) AS text", "id AS n_chars")
    rest = spark.range(3, 400).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'good words here' ELSE '### $$$ 77' END AS text", "id AS n_chars")
    labels = spark.range(2, 400).selectExpr("id AS doc_id", "1 - id % 2 AS quality")
    docs = hot.union(rest)
    first, second = fm.fit(docs, labels, 100), fm.fit(docs.repartition(7), labels, 100)
    assert taken == [100, 100] and np.array_equal(first.w, second.w)
