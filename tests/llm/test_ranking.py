"""Bradley-Terry quality scores: the fit against plain descent, thresholds, held-out accuracy, odd rows."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tallyspark.llm import ranking as K
from tallyspark.llm.queries import QUERIES

SF_LABELS = "/root/testdata/sf0.1"


def test_fit_is_the_minimum_over_all_pairs():
    rng = np.random.default_rng(4)
    better, worse = rng.normal(0.4, 1, (30, 3)), rng.normal(0, 1, (20, 3))
    d = (better[:, None, :] - worse[None, :, :]).reshape(-1, 3)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + K.RIDGE / 2 * w @ w
    w = K.fit_weights(better, worse)
    assert all(loss(w) < loss(w + e) for e in np.vstack([np.eye(3), -np.eye(3)]) * 1e-3)
    slow = np.zeros(3)
    for _ in range(4000):
        slow -= 0.2 * (-(d / (1 + np.exp(d @ slow))[:, None]).mean(axis=0) + K.RIDGE * slow)
    assert np.allclose(w, slow, atol=1e-6)


def test_threshold_is_a_weighted_quantile():
    assert K.quantile(np.array([3.0, 1.0, 2.0, 4.0]), np.ones(4), 0.5) == 2.5
    assert K.quantile(np.array([1.0, 2.0, 3.0]), np.array([1.0, 1.0, 8.0]), 0.2) == 2.5
    rng = np.random.default_rng(1)
    better, worse = rng.normal(1, 0.1, (50, len(K.NAMES))), rng.normal(0, 0.1, (10, len(K.NAMES)))
    model = K.fit(better, worse, 500, 100)
    assert (model.score(better) > 0.7).all() and (model.score(worse) < 0.7).all()


def test_statistics_of_odd_texts():
    assert K.statistics(None) == K.statistics("") == K.statistics(" \n ") == [0.0] * len(K.NAMES)
    for text in ("a", "!" * 10_000, "x" * 3_000_000, "a b " * 500_000, "ÄÖ \ud800 é\n\n\n", "\x00 \x00"):
        got = K.statistics(text)
        assert len(got) == len(K.NAMES) and np.isfinite(got).all()
    named = dict(zip(K.NAMES, K.statistics("AB cd cd\n%% x%\nAB cd cd")))
    assert named["repeated_lines"] == pytest.approx(1 / 3) and named["bare_marks"] == pytest.approx(1 / 8)
    assert named["marked_ends"] == pytest.approx(2 / 8) and named["upper_words"] == pytest.approx(2 / 8)
    assert named["adjacent_equal"] == pytest.approx(2 / 8) and named["upper"] == pytest.approx(4 / 13)
    assert named["repeated_runs"] == pytest.approx(1 / 6)


SCHEMA = "doc_id long, text string, lang string, x array<double>, id long, label int"


def test_odd_tables(spark):
    good, bad = "fine plain words stand here in a row", "X X X X %% %% %%"
    rows = [(i, (good if i % 2 else bad) + f" {'abcdefghij'[i % 10]}", None, None, i, 1) for i in range(40)]
    rows += [(None, good, "en", None, 1, 1), (90, None, "en", None, 1, 1), (91, "", None, None, 1, 1)] + rows[:3]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    marks = [(i, i % 2) for i in range(40)] + [(None, 1), (1, None), (2, 7), (3, 1), (700, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = K.learn(docs, labels)
    got = docs.withColumn("score", K.score("text", model, spark)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == bool(r.doc_id % 2) for r in got if r.doc_id is not None and r.doc_id < 40)
    for few, want in (([], 0.5), ([(1, 1)], 1.0), ([(2, 0)], 0.0)):
        flat = K.learn(docs, spark.createDataFrame(few, "doc_id long, quality int"))
        assert {r[0] for r in docs.select(K.score("text", flat, spark)).collect()} == {want}
    none = spark.createDataFrame([], SCHEMA)
    assert K.learn(none, labels).flat == pytest.approx(20 / 41)
    assert none.select(K.score("text", model, spark)).collect() == []


def test_sample_is_bounded_and_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    one, two = (K.learn(docs.repartition(n), labels.repartition(n), sample_docs=9) for n in (2, 5))
    assert np.allclose(one.weights, two.weights) and one.threshold == pytest.approx(two.threshold)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in QUERIES["op13_quality_ranking"](spark, SF_LABELS).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    labels = spark.read.parquet(f"{SF_LABELS}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()
    right = [got[r.doc_id].predicted == r.quality for r in labels]
    assert len(right) > 800 and np.mean(right) >= 0.98
    clean = [got[r.doc_id].predicted for r in labels if r.quality == 1]
    assert np.mean(clean) >= 0.99


def test_features_of_the_held_out_never_reach_the_fit(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    one = K.learn(docs, labels.where(~held))
    spoilt = docs.withColumn("text", F.when(held, F.lit("## ##")).otherwise(F.col("text")))
    assert np.allclose(one.weights, K.learn(spoilt, labels.where(~held)).weights)


def test_table_fit_takes_every_document(spark):
    """The distributed fit is the one on all rows in memory, with the loss summed pair by pair; documents beyond 1500 a label count."""
    rng = np.random.default_rng(7)
    size = len(K.NAMES)
    x = np.vstack([rng.normal(0.6, 1, (2600, size)), rng.normal(0, 1, (1900, size))]).round(2)
    label = np.repeat([1, 0], [2600, 1900])
    x[:, 3] = 1.5  # the same everywhere
    rows = [(int(k), v.tolist()) for k, v in zip(label, x)]
    rows = rows + rows[:40]  # equal scores
    x, label = np.vstack([x, x[:40]]), np.append(label, label[:40])
    model = K.fit_table(spark.createDataFrame(rows, "label int, x array<double>").repartition(5), 2640, 1900)
    want = K.fit(x[label == 1], x[label == 0], 2640, 1900)
    assert np.allclose(model.weights, want.weights, atol=1e-9) and model.threshold == pytest.approx(want.threshold, abs=1e-9)
    better, worse, w = model.norm(x[label == 1]), model.norm(x[label == 0]), model.weights
    lost = 1 / (1 + np.exp((better @ w)[:, None] - (worse @ w)[None, :]))
    slope = (worse.T @ lost.sum(axis=0) - better.T @ lost.sum(axis=1)) / lost.size + K.RIDGE * w
    assert np.abs(slope).max() < 1e-9


def test_every_labelled_document_is_learned_from(spark):
    """Documents past the first 1500 of a label by their hash change the fit."""
    docs = spark.range(4400).selectExpr(
        "id as doc_id",
        "concat(repeat('plain words ', cast(3 + id % 17 as int)), if(id % 2 = 0, 'stand here', '%% ## X'), if(id % 11 = 0, ' 7 7', '')) as text",
    )
    labels = docs.selectExpr("doc_id", "cast((doc_id % 2 = 0) as int) as quality")
    late = labels.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").offset(1500).select("doc_id")
    spoilt = docs.join(late.withColumn("late", F.lit(True)), "doc_id", "left")
    spoilt = spoilt.select("doc_id", F.when(F.col("late"), F.lit("%% ## 7 7 7")).otherwise(F.col("text")).alias("text"))
    one, two = K.learn(docs, labels), K.learn(spoilt, labels)
    assert not np.allclose(one.mean, two.mean) and not np.allclose(one.weights, two.weights)


def test_the_query_describes_each_text_once(spark, monkeypatch):
    """The labels are joined with statistics: no text reaches the fit; the scores are those of the texts."""
    given, learn = [], K.learn

    def watched(docs, *args, **kwargs):
        given.append((docs, learn(docs, *args, **kwargs)))
        return given[-1][1]

    monkeypatch.setattr(K, "learn", watched)
    got = {r.doc_id: r.score for r in QUERIES["op13_quality_ranking"](spark, SF_SMALL).collect()}
    (docs, model), = given
    assert "text" not in docs.columns
    texts = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    plain = learn(texts, labels, cutoff=0.7)
    assert np.allclose(plain.weights, model.weights) and plain.threshold == pytest.approx(model.threshold)
    want = {r.doc_id: r.score for r in texts.select("doc_id", K.score("text", plain, spark).alias("score")).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
