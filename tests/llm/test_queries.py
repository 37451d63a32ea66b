"""Registered queries on the smallest tables: oracles, contracts, pipeline stages against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from conftest import SF_SMALL
from test_quality import brute as brute_counts
from test_secrets import brute as brute_spans
from test_simhash import brute_classes, brute_fp

import corpus_pipeline as C
from tallyspark.llm import bpe, quality
from tallyspark.llm.common import DOCUMENTS, read_documents
from tallyspark.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in read_documents(spark, SF_SMALL).collect()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF_SMALL}/{name}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    want = duck.sql(ORACLES[key])
    order = sorted(df.columns)
    assert sorted(want.columns) == order
    rows = sorted((tuple(r[c] for c in order) for r in df.collect()), key=str)
    assert rows == sorted(want.select(*order).fetchall(), key=str)


def test_op1(spark, docs):
    ids = sorted(docs)
    fps = [brute_fp(docs[i].text) for i in ids]
    want = dict(zip(ids, zip((f"{f:016x}" for f in fps), brute_classes(ids, fps, 2))))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, SF_SMALL).collect()}
    assert got == want


def test_op2(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF_SMALL).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == docs[i].lang for i in held) >= 0.95 * len(held)


def test_op5(spark, docs):
    for r in QUERIES["op5_quality_rules"](spark, SF_SMALL).collect():
        n, chars, symbols, _, dups, repeats = brute_counts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dups, repeats)
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)


def test_op6_keeps_every_row(spark, docs):
    got = QUERIES["op6_mixing"](spark, SF_SMALL).collect()
    assert {r.doc_id: r.source for r in got} == {i: d.source for i, d in docs.items()} and len(got) == len(docs)


def test_op7(spark, docs):
    got = {r.doc_id: r for r in QUERIES["op7_lz_fingerprint"](spark, SF_SMALL).collect()}
    ids = sorted(docs)
    for i, following in zip(ids, ids[1:] + ids[:1]):
        t, q = docs[i].text, len(docs[i].text) // 4
        edited = t[: len(t) - q] + docs[following].text[:q]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and 0 <= got[i].near_edited <= 1
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.9 * len(got)


def test_op9(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in QUERIES["op9_byte_bpe"](spark, SF_SMALL).collect():
        ids = reference.encode_ordinary(docs[r.doc_id].text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].text.encode()).hexdigest()


def test_op10(spark, docs):
    from test_rans import library_ids

    got = {r.doc_id: r for r in QUERIES["op10_rans_output"](spark, SF_SMALL).collect()}
    at = 0
    for i in sorted(docs):
        ids = library_ids(docs[i].text)
        crc = zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), crc)
        at += len(ids)


def test_pipeline_stages_take_effect(spark, docs):
    assert [name for name, _ in C.STAGES][0] == "quality rules" and len(C.STAGES) == 5
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    df = read_documents(spark, SF_SMALL)
    verdict = {r.doc_id: r.kept for r in quality.judge(df).select("doc_id", "kept").collect()}
    kept = C.quality_rules(spark, df, SF_SMALL)
    assert kept.columns == columns
    left = {r.doc_id for r in kept.collect()}
    assert left == {i for i, k in verdict.items() if k}
    one = C.simhash_near_dedup(spark, kept, SF_SMALL)
    ids = sorted(left)
    classes = brute_classes(ids, [brute_fp(docs[i].text) for i in ids], 2)
    rows = one.collect()
    assert one.columns == columns and sorted(r.doc_id for r in rows) == sorted(set(classes))
    clean = C.secret_scans(spark, one, SF_SMALL)
    assert clean.columns == columns
    for r in clean.collect():
        spans = brute_spans(docs[r.doc_id].text)
        assert (r.text == docs[r.doc_id].text) == (not spans) and r.n_chars == len(r.text)
        assert all(docs[r.doc_id].text[b:e] not in r.text for _, b, e in spans)
    mixed = C.source_mix(spark, clean, SF_SMALL)
    assert mixed.columns == columns and sorted(map(str, mixed.collect())) == sorted(map(str, clean.collect()))
    final = C.byte_bpe(spark, mixed, SF_SMALL).collect()
    assert {r.doc_id for r in final} == {r.doc_id for r in rows} and all(r.round_trip for r in final)
    run = C.run(spark, SF_SMALL).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, run)) == sorted((r.doc_id, r.n_tokens) for r in final)


def test_pipeline_on_odd_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "word " * 40, "en", None, 1), (3, "a b " * 30, None, "s", 1)]
    rows += [(4, " ".join(f"w{i}" for i in range(60)), "en", "s", 1)] * 2
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, Quality int")
    for _, stage in C.STAGES[:-1]:
        df = stage(spark, df, SF_SMALL)
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "Quality"]
    assert [r.doc_id for r in C.byte_bpe(spark, df, SF_SMALL).collect()] == [4]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        empty = stage(spark, empty, SF_SMALL)
        assert empty.count() == 0


def test_mix_reaches_the_pipeline_result(spark, tmp_path):
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    sizes = {"a": 900, "b": 400, "c": 100}
    rows = [(1000 * k + i, words(1000 * k + i), "en", s, 400) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    spark.createDataFrame(rows, DOCUMENTS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(C.run(spark, str(tmp_path)).select("mix_position", "source", "doc_id").collect())
    assert [r.mix_position for r in got] == list(range(len(got))) and len(got) > 1300
    left = Counter(r.source for r in got)
    share = {s: left[s] ** 0.5 / sum(n**0.5 for n in left.values()) for s in left}
    inside = int(min(left[s] / share[s] for s in left)) - 32
    seen = Counter()
    for n, r in enumerate(got[:inside], 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - share[s] * n) <= 32 for s in share), n
