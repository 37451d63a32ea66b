"""Language identification: marginal probabilities by enumeration, held-out accuracy, odd rows."""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tallyspark.llm import langid as G

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def segmentations(raw, pieces):
    if not raw:
        yield []
    for j in range(1, min(len(raw), G.MAX_PIECE) + 1):
        if raw[:j] in pieces:
            for rest in segmentations(raw[j:], pieces):
                yield [pieces[raw[:j]], *rest]


@pytest.mark.parametrize("word", ["a", "the", "stst", "été"])
def test_scores_sum_over_all_segmentations(word):
    pieces = G.vocabulary(PATH)
    log_p = np.log(np.random.default_rng(1).dirichlet(np.ones(len(pieces)), 3).T)
    got = G.score_words([word, "other", word], log_p, pieces)
    number = {p: i for i, p in enumerate(pieces.pieces)}
    every = list(segmentations(b" " + word.encode(), number))
    for lang in range(3):
        want = math.log(sum(math.exp(sum(log_p[p, lang] for p in s)) for s in every))
        assert abs(got[0, lang] - want) < 1e-9 and got[2, lang] == got[0, lang]
    used = G.expected_pieces([word], np.array([5.0]), log_p[:, 0], pieces)
    weights = [math.exp(sum(log_p[p, 0] for p in s)) for s in every]
    want = np.zeros(len(pieces))
    for s, w in zip(every, weights):
        np.add.at(want, s, 5 * w / sum(weights))
    assert np.allclose(used, want)


def test_long_words_and_memory(monkeypatch):
    pieces = G.vocabulary(PATH)
    rng = np.random.default_rng(0)
    log_p = np.log(rng.dirichlet(np.ones(len(pieces)), 2).T)
    text = " ".join(["x" * 3000] + [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(900)])
    whole = G.Model(["a", "b"], np.log([0.5, 0.5]), log_p, PATH).predict([text, None, "", "12", text + " abc"])
    assert whole[1:4] == [("und", 0.0)] * 3
    monkeypatch.setattr(G, "MEMO", 40)
    monkeypatch.setattr(G, "BLOCK_WORDS", 300)
    small = G.Model(["a", "b"], np.log([0.5, 0.5]), log_p, PATH)
    assert small.predict([text, None, "", "12", text + " abc"]) == whole == small.predict([text, None, "", "12", text + " abc"])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = G.learn(docs.where(fold != 1), PATH)
    out = docs.where(fold == 1).withColumn("p", G.predict("text", model, spark)).collect()
    right = sum(r.p.lang == r.lang for r in out)
    assert right >= 0.95 * len(out)
    assert all(0 <= r.p.score <= 1 for r in out)


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"),
            (4, "123 !", None), (None, "le chat", "fr"), (6, "", "en"), (7, "der die das", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, Score string")
    model = G.learn(df, PATH)
    assert model.languages == ["de", "en"]
    got = {(r.doc_id, r.text): r.p for r in df.withColumn("p", G.predict("text", model, spark)).collect()}
    assert got[(3, None)].lang == got[(4, "123 !")].lang == got[(6, "")].lang == "und" and got[(3, None)].score == 0
    assert got[(7, "der die das")].lang == "de" and got[(1, "the cat and the dog")].lang == "en"
    nothing = G.learn(df.limit(0), PATH)
    assert {r.p.lang for r in df.withColumn("p", G.predict("text", nothing, spark)).collect()} == {"und"}
    assert df.limit(0).withColumn("p", G.predict("text", model, spark)).count() == 0


def test_words_are_letters_with_their_marks():
    assert G.words_of("½ ² ① 12 _") == [] and G.words_of(None) == []
    assert G.words_of("हिन्दी Été x1y café İ") == ["हिन्दी", "été", "x", "y", "café", "i̇"]
    for text in ("plain ASCII only", "Été ß ñ 漢字 12 ª", "a½b ①x"):
        assert G.words_of(text) == G.marked_word().findall(text.lower())


def test_numbers_that_are_no_letters_have_no_language(spark):
    model = G.learn(spark.createDataFrame([(i, "en", "the cat") for i in range(3)], "doc_id long, lang string, text string"), PATH)
    texts = spark.createDataFrame([("½ ² ①",), ("́",), ("the",)], "text string")
    assert [r[0].lang for r in texts.select(G.predict("text", model, spark)).collect()] == ["und", "und", "en"]


@pytest.mark.parametrize("most", [1, 7, 500])
def test_sample_is_the_smallest_hashes(spark, most):
    ids = spark.range(3000).select(F.col("id"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("lang"))
    ids = ids.unionByName(spark.createDataFrame([(1, "b"), (1, "a")], "id long, lang string"))
    got = sorted(map(tuple, G.least_hashed(ids, most).collect()))
    rows = sorted((r.h, r.id, r.lang) for r in ids.withColumn("h", F.xxhash64("id")).collect())
    want = sorted((i, x) for lang in "ab" for _, i, x in [r for r in rows if r[2] == lang][:most])
    assert got == want
