"""Secret spans against a plain search of every text; Boolean queries; redaction."""

from __future__ import annotations

import random
import re

import pytest

from tallyspark.llm import secrets as S


def brute(text, rules=S.RULES):
    out = []
    for nth, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m.group(r.group)) >= r.least:
                out.append((m.start(), nth, m.end()))
    return [(rules[n].kind, b, e) for b, n, e in sorted(out)]


def texts():
    rng = random.Random(3)
    bits = ["password", "PassWD", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "AKIA", "ghp_",
            "abcdef0123456789", "ABCDEFGHIJ0123456789", "é", "ſecret", "\n", "x", "A1" * 20, "-----BEGIN RSA PRIVATE KEY-----",
            "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + ".c", "xoxb-1234567890ab", "deadbeef" * 3, "to", "ken"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    out += ["", None, "token=secret: \"abcdefghijkl\"", "token = 'a/b+c_d.e=f-ghi'", "AKIA" + "Z" * 13, "AKIA" + "Z" * 14,
            "é" * 70000 + "password: hunter2hunter2" + " y" * 5000, "0123456789abcdef", "g0123456789abcde"]
    return out


def test_spans_equal_a_plain_search(spark):
    rows = [(i, t) for i, t in enumerate(texts())] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = df.select("doc_id", S.find_spans(df.text).alias("s")).collect()
    want = {i: brute(t) for i, t in rows}
    assert len(got) == len(rows)
    assert all([(s.kind, s.begin, s.end) for s in r.s] == want[r.doc_id] for r in got)
    assert sum(map(len, want.values())) > 200


def test_queries():
    q = dict((r.kind, S.trigram_query(r.pattern)) for r in S.RULES)
    assert q["hex"] is None
    assert q["access"] == ("and", (b"aki", b"kia"))
    assert b"swd" in S._named(q["assign"]) and b"ik" not in S._named(q["assign"])
    assert S.trigram_query("a|bcd") is None
    assert S.trigram_query("(abc)+x*") == b"abc"
    assert S.trigram_query("ab[cd]e?f") is not None
    assert S.trigram_query("a.c") is None


@pytest.mark.parametrize("pattern", ["fo[ox]bar|ba(z+)qux", "(?:ab|cd){2}ef", "x?yz+abc", "[^a]bcd(e|fg)hi", "abc.*def", "q(rs|tu)?vw"])
def test_every_match_satisfies_its_query(pattern):
    rng = random.Random(7)
    query = S.trigram_query(pattern)
    texts = ["".join(rng.choice("abcdefghiqrstuvwxyzo") for _ in range(60)) for _ in range(200)]
    parts = ["fooxbar", "foobar", "foxbar", "bazzqux", "abcdef", "ababef", "yzabc", "xyzzabc", "zbcdehi", "zbcdfghi", "abc--def", "qvw", "qrsvw"]
    texts += ["".join(rng.choice(parts + ["m"]) for _ in range(3)) for _ in range(300)]
    rows = set(S.Segment(texts, S._named(query)).rows(query).tolist())
    hits = {i for i, t in enumerate(texts) if re.search(pattern, t)}
    assert hits and hits <= rows


def test_redaction(spark):
    rows = [(1, "a password=abcdefghijkl b", 1), (2, "clean", 1), (3, None, 2), (4, "", 2),
            (5, "é token: 0123456789abcdef0123 AKIA" + "Q" * 20, 3), (6, "x" * 60000 + " deadbeefdeadbeef", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _spans int")
    out = {r.doc_id: r for r in S.redact(df).collect()}
    assert S.redact(df).columns == df.columns
    assert out[1].text == "a [SECRET] b" and out[2].text == "clean" and out[3].text is None and out[4].text == ""
    assert out[5].text == "é [SECRET] [SECRET]" and out[6].text == "x" * 60000 + " [SECRET]" and out[6]._spans == 3
    assert S.redact(df.limit(0)).count() == 0


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "token=abcdefghijkl rest", 5, "y"), (2, None, 6, None)]
    got = S.redact(spark.createDataFrame(rows, "doc_id long, text string, _Spans long, _spans_ string"))
    assert got.columns == ["doc_id", "text", "_Spans", "_spans_"]
    assert sorted(map(tuple, got.collect())) == [(1, "[SECRET] rest", 5, "y"), (2, None, 6, None)]
