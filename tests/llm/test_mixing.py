"""Pfair mix: windows, prefix deviation, whole rows, brute-force schedule."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pytest

from tallyspark.llm import mixing as M

DOC = "doc_id long, text string, source string"


def brute_frame(units: list[int], frame: int) -> list[tuple[int, int]]:
    done, out = [0] * len(units), []
    for t in range(frame):
        ready = [
            (math.ceil((k + 1) * frame / w), i) for i, (k, w) in enumerate(zip(done, units)) if k < w and k * frame // w <= t
        ]
        due, i = min(ready)
        assert due > t
        out.append((i, done[i]))
        done[i] += 1
    assert done == units
    return out


@pytest.mark.parametrize("units,frame", [([7, 2, 1], 10), ([1], 1), ([333, 333, 334], 1000), ([1] * 12 + [88], 100)])
def test_frame_schedule_equals_brute_force(spark, units, frame):
    df = spark.createDataFrame([(f"s{i:02}", 1, u) for i, u in enumerate(units)], "source string, rows long, units long")
    got = {(r.source, r.k): r.slot for r in M.frame_schedule(df, frame).collect()}
    assert got == {(f"s{i:02}", k): t for t, (i, k) in enumerate(brute_frame(units, frame))}


def test_units_sum_to_the_frame(spark):
    df = spark.createDataFrame([("a", 5, 0.7), ("b", 5, 0.2), (None, 5, 0.1), ("d", 5, 1e-9)], "source string, rows long, share double")
    got = {r.source: r.units for r in M.frame_units(df, 100).collect()}
    assert sum(got.values()) == 100 and got["d"] == 1 and got["a"] == 68


def mixed(spark, weights=None, block=2, frame=50):
    rows = [(i, f"t{i}", "hot") for i in range(900)] + [(1000 + i, f"u{i}", "b") for i in range(200)]
    rows += [(2000 + i, None, None) for i in range(61)] + [(None, f"n{i}", "b") for i in range(5)] + [(5, "t5", "hot")] * 3
    df = spark.createDataFrame([(*r, 1.5) for r in rows], DOC + ", Slot double")
    return rows, df, M.schedule(df, weights, block=block, frame=frame, parts=8)


@pytest.mark.parametrize("weights", [None, {"hot": 1.0, "b": 8.0}])
def test_windows_and_prefix_deviation(spark, weights):
    rows, df, out = mixed(spark, weights)
    assert out.columns == [*df.columns, "rank", "block", "slot_", "release", "deadline", "in_mix"]
    got = out.collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
        assert r.release <= r.slot_ < r.deadline and r.block == r["rank"] // 2
    slots = {}
    for s, rs in by_source.items():
        assert sorted(r["rank"] for r in rs) == list(range(len(rs)))
        for r in rs:
            assert slots.setdefault(r.slot_, (s, r.block)) == (s, r.block)
    inside = sorted(t for t in slots if any(r.in_mix and r.slot_ == t for r in by_source[slots[t][0]]))
    assert inside == list(range(len(inside))) and len(inside) > 20
    units = Counter(slots[t][0] for t in inside[:50])
    seen = Counter()
    for n, t in enumerate(inside, 1):
        seen[slots[t][0]] += 1
        assert all(abs(seen[s] - u * n / 50) < 1 for s, u in units.items())


def test_order_is_laid_out(spark):
    rows, df, out = mixed(spark)
    want = [r.source for r in sorted(out.collect(), key=lambda r: (r.slot_, r["rank"]))]
    laid = M.in_order(df, block=2, frame=50, parts=8)
    assert laid.columns == df.columns
    assert [r.source for r in laid.collect()] == want


def test_empty_and_too_many_sources(spark):
    assert M.schedule(spark.createDataFrame([], DOC)).count() == 0
    df = spark.createDataFrame([(i, "t", f"s{i}") for i in range(5)], DOC)
    with pytest.raises(Exception, match="more sources than slots"):
        M.schedule(df, frame=4).count()


SIZES = {"a": (900, 0.7), "b": (500, 0.2), None: (200, 0.0996), "d": (9, 0.0004)}
MANY = {f"s{i:04}": (4, float(1 + i % 7)) for i in range(1100)}


@pytest.mark.parametrize("sizes,block", [(SIZES, 1), (SIZES, 2), (MANY, 2)])
def test_every_prefix_holds_the_given_weights(spark, sizes, block):
    rows = [(i, "t", s) for s, (n, _) in sizes.items() for i in range(n)]
    total = sum(w for _, w in sizes.values())
    weights = {s: w for s, (_, w) in sizes.items() if s is not None}
    if None in sizes:  # a source without a weight has the root of its rows
        total = sum(weights.values()) + sizes[None][0] ** 0.5
    share = {s: (sizes[s][0] ** 0.5 if s is None else w) / total for s, (_, w) in sizes.items()}
    got = M.schedule(spark.createDataFrame(rows, DOC), weights, block=block).collect()
    assert Counter((r.doc_id, r.text, r.source) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
        assert not r.in_mix or r.release <= r.slot < r.deadline
    inside = sorted({r.slot for r in got if r.in_mix})
    assert inside == list(range(len(inside))) and all(r.in_mix == (r.slot < len(inside)) for r in got)
    blocks = {s: -(-n // block) for s, (n, _) in sizes.items()}
    assert len(inside) >= min(b / share[s] for s, b in blocks.items()) - 1 / min(share[s] for s in share)
    seen = Counter()
    for n in inside:
        assert slots[n][1] == seen[slots[n][0]]
        seen[slots[n][0]] += 1
        assert all(abs(seen[s] - share[s] * (n + 1)) < 1 + 1e-6 for s in share)
    assert any(seen[s] == blocks[s] for s in share)


def test_passes_hand_on_their_state(spark):
    df = spark.createDataFrame([("a", 700, 0.55), ("b", 700, 0.3), (None, 700, 0.15)], "source string, rows long, share double")
    targets = M.target_shares(df, 1)
    want = sorted(map(str, M.target_schedule(targets).collect()))
    assert sorted(map(str, M.target_schedule(targets, slots=64, steps=16).collect())) == want and len(want) > 1000


def test_query_tells_rows_of_one_id_apart_by_text(spark, tmp_path):
    from tallyspark.llm.common import DOCUMENTS
    from tallyspark.llm.queries import QUERIES

    rows = [(None, f"n{i}", "en", "a", 2) for i in range(300)] + [(7, f"s{i}", "en", "b", 2) for i in range(40)] + [(8, None, "en", "b", 0)] * 2
    spark.createDataFrame(rows, DOCUMENTS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    query = lambda: QUERIES["op6_mixing"](spark, str(tmp_path))
    out = query()
    assert "text" not in out.columns
    got = out.collect()
    assert Counter((r.doc_id, r.source) for r in got) == Counter((r[0], r[3]) for r in rows)
    assert sorted(r["rank"] for r in got if r.source == "a") == list(range(300))
    docs = spark.read.schema(DOCUMENTS).parquet(f"{tmp_path}/documents.parquet")
    parts = docs.where("doc_id is null").select(M.F.shiftrightunsigned(M.F.xxhash64("doc_id", "text"), 54)).distinct().count()
    assert parts > 100  # rows without an id are spread over the parts
