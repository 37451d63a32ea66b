"""Importance resampling: brute force, longer features, ranks by regular sampling, odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import psrs
from tallyspark.llm import resample as R

SCHEMA = "doc_id long, text string, rank string, score double"


def words(text):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))


def brute(rows, target, percent, buckets, longest, least):
    def features(text):
        w = words(text)
        return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in xs for f in features(x)) for xs in ([r[1] for r in rows], target))
    ns, nt = s.total(), t.total()
    out = []
    for doc_id, text, *_ in rows:
        weight = 0
        for f in features(text):
            b = bucket(f)
            weight += math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(words(text)), len(features(text)), weight, score, None])
    ranked = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    for n, r in enumerate(ranked[: percent * len(ranked) // 100], 1):
        r[5] = n
    return sorted(map(tuple, out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def corpus(n=160):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(["Alpha", "beta", "été", "x9", "γ", "delta."]) for _ in range(k))
    rows = [(i, text(rng.randint(0, 40)), "r", 0.5) for i in range(n)]
    return rows + [(None, text(30), "r", 0.5), (500, None, "r", 1.0), (501, "", "r", 1.0), (502, "beta " * 400_000, "r", 1.0)] + rows[:5]


@pytest.mark.parametrize("longest,buckets,least", [(1, 10_000, 20), (3, 64, 20), (1, 7, 0)])
def test_against_brute_force(spark, monkeypatch, longest, buckets, least):
    monkeypatch.setattr(R, "HELD", 40)
    rows, target = corpus(), ["beta beta γ", None, "", "x9 alpha"]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = R.resample(docs, aim, percent=30, buckets=buckets, longest=longest, least_words=least)
    assert found(got) == brute(rows, target, 30, buckets, longest, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(R.resample(none, none)) == []
    docs = spark.createDataFrame([(1, "a b " * 20, "", 0.0)], SCHEMA)
    assert found(R.resample(docs, none, percent=100)) == brute([(1, "a b " * 20)], [], 100, 10_000, 1, 20)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_ranks_by_regular_sampling(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([-5, 0, 0, 0, 3, 2**62]), rng.choice([None, 1, 2, i]), "x") for i in range(3000)]
    rows += [(0, 2, "same")] * 1500  # a third of all rows alike
    df = spark.createDataFrame(rows, "a long, b long, _row string").repartition(6)
    got = [(r.a, r.b, r.n) for r in psrs.with_rank(df, ["a", "b"], "n", ranges).collect()]
    assert sorted(n for *_, n in got) == list(range(1, len(rows) + 1))
    want = sorted(((a, b) for a, b, _ in rows), key=lambda x: (x[0], x[1] is None, x[1] or 0))
    assert [(a, b) for a, b, _ in sorted(got, key=lambda r: r[2])] == want


def test_equal_rows_spread_over_ranges(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.lit(7).cast("long").alias("a"))
    ranked = psrs.with_rank(df, ["a"], "n", 10).withColumn("at", F.spark_partition_id())
    sizes = [r["count"] for r in ranked.groupBy("at").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 2 * 2000 + 10


def test_rows_at_splitters():
    keys = [np.array([1, 1, 2, 5]), np.array([0, 1, 0, 0])]
    cuts = [np.array([1, 2, 2]), np.array([1, 0, 3])]
    assert psrs._ranges(keys, cuts).tolist() == [0, 1, 2, 3]
