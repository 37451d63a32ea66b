"""Source divergence: brute force over whole tables, odd rows, small blocks, large counts."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import divergence as D
from tallyspark.llm.words import LETTERS, words

SCHEMA = "doc_id long, text string, lang string, source string, term string, v long"
WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for r in rows:
        lang, source, found = r[2] or "", r[3] or "", WORD.findall((r[1] or "").translate(low))
        groups.add((lang, source))
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def share(of, kept=kept):
            by = sum(of[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (of[t] + 2) // by for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = share(count[lang, source])
        q = share(sum((c for (x, _), c in count.items() if x == lang), Counter()))
        pairs = [(s, sum(f(p[t], o[t]) for t in kept)) for x, s in groups if x == lang and s != source for o in [share(count[lang, s])]]
        terms = [(t, f(p[t], q[t])) for t in kept if count[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, i, v, n) for n, (i, v) in enumerate(ranked, 1) if part == "pair" or n <= top]
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


ROWS = [
    (1, "The cat, the DOG; the cat", "en", "a", "x", 1),
    (2, "dog dog été Été x1y", "en", "b", None, 2),
    (2, "dog dog été Été x1y", "en", "b", None, 2),
    (3, None, "en", "c", "x", 3),
    (4, "", None, None, "x", 4),
    (None, "cat cat the", None, "a", "x", 5),
    (6, "cat the " * 60_000 + "rare", "en", "a", "x", 6),
    (7, "uno dos", "es", "a", "x", 7),
    (8, "the cat dog ß", "en", "d", "x", 8),
    (9, "the cat the", "en", None, "x", 9),
]


@pytest.mark.parametrize("min_docs,blocks", [(1, {}), (2, {}), (2, {"block_entries": 2}), (3, {"block_bytes": 5}), (9, {})])
def test_against_brute_force(spark, min_docs, blocks):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = rows_of(D.audit(docs, min_docs=min_docs, top_terms=3, **blocks))
    assert got == brute(ROWS, min_docs, 3)


def test_many_sources_and_flushed_pairs(spark, monkeypatch):
    rows = [(i, f"w{'abcdefg'[i % 7]} common w{'abcdefg'[i * i % 7]}", "en", f"s{i % 23}", None, 0) for i in range(140)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 10, 10)
    assert rows_of(D.audit(docs)) == want
    whole = D.corrections
    monkeypatch.setattr(D, "corrections", lambda shares: whole(shares, held=1))
    assert rows_of(D.audit(docs)) == want


def test_empty(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_share_is_exact_for_large_counts(spark):
    cases = [(0, 1, 1), (10**13, 4 * 10**15, 10**9), (7, 10**15 + 3, 12345), (3, 5, 2), (4 * 10**15, 4 * 10**15, 1)]
    df = spark.createDataFrame(cases, "c long, n long, v long")
    got = [r[0] for r in df.select(D.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert got == [1 + 10**9 * (c + 2) // (n + 2 * v) for c, n, v in cases]


def test_runs_are_sorted_and_words_whole():
    block = D.Block()
    block.add(("en", "b"), b"b a b")
    block.add(("en", "a"), b"b")
    run = pa.Table.from_batches(block.run()).to_pylist()
    assert [(r["term"], r["source"], r["count"], r["docs"]) for r in run] == [("a", "b", 1, 1), ("b", "a", 1, 1), ("b", "b", 2, 1)]
    text = b"ab " + b"c" * 50 + b" 1 d-e\xc3\xa9 " * 9
    whole = [w for some in words(text, LETTERS) for w in some]
    for size in (1, 2, 3, 7, 64):
        assert [w for some in words(text, LETTERS, size) for w in some] == whole
