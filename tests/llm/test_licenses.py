"""License scan against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import licenses as L
from tallyspark.llm.common import DOCUMENTS
from tallyspark.llm.queries import QUERIES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, threshold=L.THRESHOLD):
    words = re.findall(WORD, ascii_lower(text))
    places = sorted(
        (label, i)
        for phrase, label in L.PHRASES
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )
    blocks = []
    for at, line in enumerate(ascii_lower(text).split("\n")):
        own = set(re.findall(WORD, line))
        for label, statement in L.TEMPLATES:
            t = L.template_words(statement)
            if len(own & t) >= L.need(len(t), threshold):
                blocks.append((at, label, len(own & t) / len(t)))
    return len(words), places, sorted(blocks)


def texts():
    rng = random.Random(9)
    out = [None, "", "\n", "under the MIT license", "Released under the MIT License.\nunder the mit license", "cc by-nc CC BY-NC cc by nc",
           "punder the mit license under the mit licenses", "apache license, version 2.0 apache\nlicense version\n2", "é under the mit license é",
           "LİCENSE under the mİt license", "K cc by nc", "x " * 40000 + "cc by nc", "cc by nc " * 500, "ÉTÉ CC By Nc"]
    vocab = sorted(set().union(*(L.template_words(s) for _, s in L.TEMPLATES))) + ["foo", "bar", "é"]
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 4)):
            label, s = rng.choice(L.TEMPLATES)
            words = re.findall(r"\w+", s)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocab).upper()
            rng.shuffle(words)
            lines.append(rng.choice([" ", ", ", "-"]).join(words))
        out.append("\n".join(lines))
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_places_and_blocks_equal_brute_force(spark, threshold):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, texts()[3], "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Blocks string")
    out = L.scan(df, threshold=threshold)
    assert out.columns == ["doc_id", "text", "Blocks", "n_words", "places", "blocks_"]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        n, places, blocks = brute(r.text, threshold)
        assert r.n_words == n and sorted((p.label, p.word) for p in r.places) == places, r.text
        assert sorted((b.line, b.label, b.containment) for b in r["blocks_"]) == blocks, r.text


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert L.scan(df).where(F.col("n_words") >= 0).count() == 0


def brute_windows(text, threshold=L.THRESHOLD):
    """Labels with a window of the template's length, across line ends."""
    words = re.findall(WORD, ascii_lower(text))
    out = set()
    for label, statement in L.TEMPLATES:
        t, size = L.template_words(statement), len(re.findall(r"\w+", statement))
        if any(len(set(words[i : i + 2 * size]) & t) >= L.need(len(t), threshold) for i in range(0, len(words), size // 2)):
            out.add(label)
    return out


def test_wrapped_statements_are_found(spark, tmp_path):
    rng = random.Random(2)
    filler = lambda n: [f"f{rng.randrange(999)}" for _ in range(n)]
    texts, own = [], []
    for label, statement in L.TEMPLATES:
        words = statement.split()
        for cut in range(1, len(words)):
            for before in (0, 13):
                lines = [filler(before) + words[:cut], words[cut:] + filler(40), filler(60)]
                texts.append("\n".join(" ".join(x) for x in lines))
                own.append(label)
    scattered = sorted(L.template_words(dict(L.TEMPLATES)["apache-2"]))
    texts.append("\n".join(" ".join([w, *filler(30)]) for w in scattered))  # all words, but nowhere together
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS)
    for r in L.scan(df, windows=True).collect():
        assert {b.label for b in r.wrapped} == brute_windows(r.text), r.text
        assert len(r.wrapped) == len({b.label for b in r.wrapped})
        assert all(0 <= b.line < r.text.count("\n") + 1 and 0.8 <= b.containment <= 1 for b in r.wrapped)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    labels = {r.doc_id: r.labels for r in QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()}
    assert all(label in labels[i].split(",") for i, label in enumerate(own)) and labels[len(own)] == ""


def test_one_long_line_is_cut_into_windows_too(spark, tmp_path):
    words = dict(L.TEMPLATES)["apache-2"].split()
    filler = " ".join(f"f{i}" for i in range(500))
    texts = [" ".join(f"{filler} {w}" for w in words), f"{filler} {' '.join(words)} {filler}", " ".join(words), " ".join(words[:4])]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.score) for r in QUERIES["op8_license_scan"](spark, str(tmp_path)).collect()}
    assert got[0] == ("", 0.0) and got[3] == ("", 0.0) and got[1][0] == got[2][0] == "apache-2"


def test_query_equals_its_statement_on_wrapped_and_single_lines(spark, tmp_path):
    import duckdb

    from tallyspark.llm.queries import ORACLES

    rng = random.Random(4)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts())]
    for label, statement in L.TEMPLATES:
        words = statement.split()
        for cut in range(1, len(words), 3):
            before = [f"f{rng.randrange(99)}" for _ in range(cut * 5)]
            rows += [(len(rows), " ".join(before + words[:cut]) + mark + " ".join(words[cut:] + before), "en", "s", 0) for mark in "\n \r\t"]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    df = QUERIES["op8_license_scan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    order = sorted(df.columns)
    want = con.sql(ORACLES["op8_license_scan"]).select(*order).fetchall()
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == sorted(want, key=str)
