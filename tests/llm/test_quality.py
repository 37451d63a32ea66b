"""Quality statistics, the MCD estimate and verdicts against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality as Q

DOC = "doc_id long, text string, lang string, source string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {g for g, n in Counter(grams).items() if n > 1}
    covered = {i + k for i, g in enumerate(grams) if g in often for k in range(5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(11)
    out = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 4, 5, 6, 9, 10, 30, 60)]
    out += ["a b c d e " * 4, "x a b c d e y a b c d e z", None, "", " \n\t ", "l one\nl one\n\n \nl two\nl one", "# $ % é|<>&*",
            "a\x85b c", "w " * 30000, "é" * 90000, "\x0ba\x0cb\x1cc d e f", "a a a a a a", "a a a a a"]
    out += [" ".join(rng.choice(["ab", "c", "\n", "d\ne", "##"]) for _ in range(80)) for _ in range(60)]
    return out


def test_counts_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", Q.measure(F.col("text")))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    got = {r.doc_id: tuple(r.m[n] for n in names) for r in df.collect()}
    assert got == {i: brute(t) for i, t in rows}


def brute_fit(x, steps=Q.STEPS):
    """The same estimate with numpy: two starts, C-steps on binned distances, smaller determinant."""
    inside = Q.SUPPORT / Q.chi_square_share(Q.chi_square_quantile(Q.SUPPORT), Q.DIM + 2)

    def estimate(rows):
        cov = inside * np.cov(rows.T, bias=True)
        return rows.mean(axis=0), cov + np.diag([(f * Q.UNITS_PER_ONE) ** 2 for f in Q.FLOORS])

    def distance(c, s):
        return np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(s), x - c)

    bins = np.floor(x / 250 + 0.5)
    low, high = (np.array([sorted(b)[math.ceil(len(b) * q) - 1] for b in bins.T]) for q in (0.2, 0.8))
    middle = ((bins >= low) & (bins <= high)).sum(axis=1) >= Q.DIM - 1
    best = None
    for start in (x, x[middle]):
        c, s = estimate(start)
        for _ in range(steps):
            b = np.floor(np.log2(1 + distance(c, s)) * Q.BINS_PER_DOUBLING)
            last = sorted(b)[math.ceil(len(b) * Q.SUPPORT) - 1]
            c, s = estimate(x[b <= last])
        det = np.linalg.slogdet(s)[1]
        if best is None or det < best[0] - 1e-12:
            best = (det, c, s)
    return best[1], best[2]


def test_mcd_equals_brute_force_and_resists_outliers(spark):
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal([16000, 900, 300, 400], [300, 200, 100, 150], (800, 4)))
    x[:120] += [9000, 6000, 0, 5000]
    rows = [("u", *map(int, r)) for r in np.abs(x)]
    df = spark.createDataFrame(rows, "unit string, x0 long, x1 long, x2 long, x3 long")
    got = Q.fit(df).collect()[0]
    centre, cov = brute_fit(np.abs(x))
    assert np.allclose([got[f"c{i}"] for i in range(4)], centre, rtol=1e-9)
    inverse = np.linalg.inv(cov)
    assert np.allclose([got[f"p{i}{j}"] for i, j in Q.PAIRS], [inverse[i, j] for i, j in Q.PAIRS], rtol=1e-6, atol=1e-15)
    assert abs(got["c0"] - 16000) < 100  # the 15 % of outliers do not move the centre


def test_verdicts(spark):
    rng = random.Random(1)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(20, 400))), "en", "s1") for i in range(300)]
    rows += [(1000 + i, " ".join("#$%" + rng.choice(vocab) for _ in range(200)), "en", "s1") for i in range(10)]
    rows += [(2000 + i, " ".join(rng.choice(vocab) * 9 for _ in range(100)), "en", "s1") for i in range(10)]
    rows += [(3000, None, None, None), (3001, "", "en", "s1"), (3002, "too short", "en", "s1"), (3003, "a b c d e " * 9, "en", "s1")]
    rows += [(4000, " ".join(vocab[:50]), None, None), (4000, " ".join(vocab[:50]), None, None), (None, " ".join(vocab[:40]), "fr", "s9")]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows], DOC + ", kept int, Unit string, distance boolean")
    out = Q.judge(df)
    assert out.columns == [*df.columns, "quality", "base_failed", "distance_", "kept_"]
    got = Counter((r.doc_id, r["kept_"]) for r in out.collect())
    assert sum(got.values()) == len(rows)
    for r in rows:
        dropped = r[0] is not None and 1000 <= r[0] < 4000
        assert (r[0], not dropped) in got, r[0]


def test_empty_table(spark):
    assert Q.judge(spark.createDataFrame([], DOC)).count() == 0


@pytest.mark.parametrize("share,want", [(0.75, 5.385), (0.975, 11.143)])
def test_chi_square(share, want):
    assert abs(Q.chi_square_quantile(share, 4) - want) < 1e-3
