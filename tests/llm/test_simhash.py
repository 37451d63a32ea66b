"""SimHash classes against a brute-force version."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tallyspark.llm import simhash as S
from tallyspark.llm.graph import components

DOC = "doc_id long, text string, lang string"


def brute_fp(text, n=3):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(ids, fps, d):
    label = list(range(len(fps)))
    for _ in fps:
        for i in range(len(fps)):
            for j in range(len(fps)):
                if (fps[i] ^ fps[j]).bit_count() <= d and label[j] > label[i]:
                    label[j] = label[i]
    named = {}
    for i, g in zip(ids, label):
        if i is not None:
            named[g] = min(named.get(g, i), i)
    return [named.get(g) for g in label]


@pytest.mark.parametrize(
    "text", ["", None, " \t\n", "one", "One two", "a b c", "A b C d É\x85x y", "x " * 5000, "ß\x0bq\x0cr s t"]
)
def test_fingerprint_is_the_brute_force_one(text):
    assert S.simhash64(text, 3) % 2**64 == brute_fp(text)


def near_texts():
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice(["ab", "cd", "ef", "gh", "ij", "kl", "Mn"], 400)) for _ in range(6)]
    rows = [(i, t, "en", 1) for i, t in enumerate(base)]
    for i in range(60):
        words = base[i % 6].split()
        words[int(rng.integers(400))] = "zz"
        rows.append((100 + i, " ".join(words), None, 2))
    rows += [(7, base[0], "en", 3), (7, base[0], "en", 3), (None, base[1], "en", 4), (None, "only here, no id", "x", 5)]
    rows += [(900, None, None, None), (901, "", "en", 1), (902, " \n ", "en", 1)]
    return rows


@pytest.mark.parametrize("bucket", [1, 2048])
def test_classes_equal_brute_force(spark, bucket):
    rows = near_texts()
    df = spark.createDataFrame(rows, DOC + ", fp int")
    got = S.classes(df, max_bucket=bucket).collect()
    fps = [brute_fp(r[1]) for r in rows]
    want = sorted(zip([r[0] for r in rows], fps, brute_classes([r[0] for r in rows], fps, 2)), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


def test_links_connect_dense_fingerprints(spark):
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**10, 600)} | {int(x) for x in rng.integers(-(2**63), 2**63, 300)}
    fps |= {f ^ (1 << int(rng.integers(63))) for f in list(fps)[:200]}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    order = sorted(fps)
    want = brute_classes(order, order, 2) if len(order) < 100 else None
    parent = {f: f for f in order}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(order):
        for b in order[i + 1 :]:
            if ((a ^ b) % 2**64).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    for bucket in (3, 2048):
        found = S.links(df, 2, bucket)
        assert all(((r.a ^ r.b) % 2**64).bit_count() <= 2 for r in found.collect())
        got = {r.node: r.root for r in components(found).collect()}
        assert {f: got.get(f, f) for f in order} == {f: root(f) for f in order}
    assert want is None


def test_components_of_a_long_path(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1002), (1002, 1000)], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1002: 1000}


def test_keep_one_row_of_each_class(spark):
    rows = near_texts()
    df = spark.createDataFrame(rows, DOC + ", Extra int")
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    fps = [brute_fp(r[1]) for r in rows]
    classes = brute_classes(list(range(len(rows))), fps, 2)
    assert kept.count() == len(set(classes))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(
        x for x in brute_classes([r[0] for r in rows], fps, 2) if x is not None
    )


def test_empty_table(spark):
    df = spark.createDataFrame([], DOC)
    assert S.classes(df).count() == 0
    assert S.keep_one(df).count() == 0


def test_keep_one_row_of_each_class_when_ids_repeat(spark):
    rng = random.Random(3)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (3, b), (4, c), (5, c), (5, d), (6, d), (7, c)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (4, c), (5, d)])


def test_keep_one_with_columns_of_the_helpers_names(spark):
    rows = [(1, "a b c d", 7, "x", 1, True, "k"), (2, "a b c d", 8, "y", 2, False, "l"), (3, "other words here now", 9, "z", 3, None, "m")]
    rows += [(None, "a b c d", 1, "q", 4, None, "n"), (None, "alone in its class", 1, "q", 4, None, "o")]
    schema = "doc_id long, text string, _nth long, FP string, class_fp long, _own boolean, nth string"
    got = S.keep_one(spark.createDataFrame(rows, schema))
    assert got.columns == ["doc_id", "text", "_nth", "FP", "class_fp", "_own", "nth"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((rows[i] for i in (0, 2, 4)), key=str)
