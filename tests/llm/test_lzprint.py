"""Lempel-Ziv fingerprints and neighbours against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import lzprint as Z


def brute_phrases(raw: bytes) -> set[bytes]:
    out, begin = set(), 0
    for end in range(1, len(raw) + 1):
        if raw[begin:end] not in out:
            out.add(raw[begin:end])
            begin = end
    return out


def texts():
    rng = random.Random(6)
    out = ["", "a", "aa", "abababab", "é日本\x00\x00", "x" * 50000, None]
    return out + ["".join(rng.choice("abcd \n") for _ in range(rng.randint(0, 400))) for _ in range(60)]


@pytest.mark.parametrize("text", texts()[:30])
def test_phrases(text):
    raw = (text or "").encode()
    p = Z.Phrases()
    p.feed(raw[: len(raw) // 2])
    mark = p.mark()
    p.feed(b"something else" * 9)
    p.back(mark)
    p.feed(raw[len(raw) // 2 :])
    assert len(p.hashes) - 1 == len(set(p.hashes[1:])) == len(brute_phrases(raw))
    assert np.array_equal(p.sketch(), Z.sketch_of(text))


def test_likeness_estimates_jaccard():
    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh ") for _ in range(6000))
    for share in (0.1, 0.5, 0.9):
        other = base[: int(6000 * share)] + "".join(rng.choice("abcdefgh ") for _ in range(6000 - int(6000 * share)))
        a, b = brute_phrases(base.encode()), brute_phrases(other.encode())
        true = len(a & b) / len(a | b)
        assert abs(Z.likeness(Z.sketch_of(base), Z.sketch_of(other)) - true) < 0.2
    assert Z.likeness(Z.sketch_of(base), Z.sketch_of(base)) == 1
    assert Z.likeness(Z.sketch_of(""), Z.sketch_of(None)) == 1 and Z.likeness(Z.sketch_of(""), Z.sketch_of("a")) == 0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        a, b, c = Z.sketch_of(t), Z.sketch_of(edited), Z.sketch_of(nxt)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), Z.as_text(a), Z.as_text(b), Z.likeness(a, b), Z.likeness(a, c)))
    return out


@pytest.mark.parametrize("ids", ["plain", "ties", "one"])
def test_neighbours_equal_brute_force(spark, ids):
    rows = [(i * 7, t) for i, t in enumerate(texts())]
    if ids == "ties":
        rows = [(i // 5, t) for i, t in enumerate(texts())] + [(None, "lost"), (None, "b"), (3, "same"), (3, "same")]
    if ids == "one":
        rows = [(4, "lonely text of one document")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, bucket int")
    got = Z.with_neighbours(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_columns_and_empty_table(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", Z.fingerprint("text"))
    for r in df.withColumn("s", Z.similarity("fp", "fp")).collect():
        assert r.fp == Z.as_text(Z.sketch_of(r.text)) and r.s == 1
    assert Z.with_neighbours(spark.createDataFrame([], "doc_id long, text string")).count() == 0
