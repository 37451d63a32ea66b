"""Property tests of the greedy fold against a plain sequential walk."""

from __future__ import annotations

import random
from datetime import timedelta

import numpy as np
import pytest
from conftest import SALE_CMD, TODAY, products_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspark.operators import ledger as L
from tallyspark.operators.fold import ADD, SKIP, SLICE, TAKE, greedy_fold, replay, run_steps

CMD = st.tuples(st.sampled_from([ADD, TAKE, TAKE, SKIP]), st.integers(min_value=0, max_value=9))
KEYS = st.lists(st.tuples(st.integers(min_value=0, max_value=15), st.lists(CMD, min_size=1, max_size=12)),
                min_size=1, max_size=6)


def walk(opening, cmds):
    level, out = opening, []
    for kind, a in cmds:
        if kind == ADD:
            level += a
            out.append((True, level))
        elif kind == TAKE and a <= level:
            level -= a
            out.append((True, level))
        else:
            out.append((False, level))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=KEYS)
def test_fold_matches_sequential_walk(spark, keys):
    rows, expected = [], {}
    for k, (opening, cmds) in enumerate(keys):
        for pos, ((kind, a), (ok, lvl)) in enumerate(zip(cmds, walk(opening, cmds))):
            rows.append((k, pos, kind, a, opening, f"{k}-{pos}"))
            expected[(k, pos)] = (ok, lvl)
    df = spark.createDataFrame(rows, "k long, pos long, _kind int, _amount long, _opening long, sid string")
    got = {(r.k, r.pos): r for r in greedy_fold(df, ["k"], ["pos"], spread="sid").collect()}
    assert set(got) == set(expected)  # accepted + rejected = input
    for key, (ok, lvl) in expected.items():
        r = got[key]
        assert r.accepted == ok
        if r._kind != SKIP:  # a skipped row may be walked apart from its key
            assert r.level_after == lvl >= 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(qs=st.lists(st.integers(min_value=1, max_value=9), min_size=2, max_size=14),
       stock=st.integers(min_value=0, max_value=30), cut=st.integers(min_value=1, max_value=13))
def test_batches_compose(spark, qs, stock, cut):
    """apply(a + b) == apply(b) after apply(a) when a precedes b."""
    cut = min(cut, len(qs) - 1)
    p = products_df(spark, [(1, 1, "A", "c", 1, 2, stock, 0)])
    cmds = [(1, 1, f"s{i:03d}", TODAY + timedelta(days=i), q) for i, q in enumerate(qs)]
    both = spark.createDataFrame(cmds, SALE_CMD)
    a, b = spark.createDataFrame(cmds[:cut], SALE_CMD), spark.createDataFrame(cmds[cut:], SALE_CMD)
    one = L.apply_sales_stock(p, both).collect()[0].stock_quantity
    two = L.apply_sales_stock(L.apply_sales_stock(p, a), b).collect()[0].stock_quantity
    assert one == two >= 0


def marked_walk(opening, mark, cmds):
    """cmds: (kind, amount, mark) in order → (accepted, level, mark) per command."""
    out = []
    for (ok, level), (kind, a, m) in zip(walk(opening, [c[:2] for c in cmds]), cmds):
        mark = m if m is not None else mark
        out.append((ok, level, mark))
    return out


FOLD_ROW = "k long, day int, pos {id}, _kind int, _amount long, _opening long, _mark long, _opening_mark long, sid string"


def check_marked(spark, keys, id_type="long", name=lambda pos: pos):
    """keys: (opening, [(day, kind, amount, mark)]) with days ascending; ids are ``name(pos)``, ascending in a day."""
    rows, expected = [], {}
    for k, (opening, cmds) in enumerate(keys):
        states = marked_walk(opening, 700 + k, [c[1:] for c in cmds])
        for pos, ((day, kind, a, m), state) in enumerate(zip(cmds, states)):
            rows.append((k, day, name(pos), kind, a, opening, m, 700 + k, f"{k}-{pos}"))
            expected[(k, name(pos))] = (*state, kind)
    df = spark.createDataFrame(rows, FOLD_ROW.format(id=id_type))
    out = greedy_fold(df, ["k"], ["day", "pos"], mark=True, spread="sid")
    got = {(r.k, r.pos): r for r in out.collect()}
    assert set(got) == set(expected)
    for key, (ok, level, mark, kind) in expected.items():
        assert got[key].accepted == ok, key
        if kind != SKIP:
            assert (got[key].level_after, got[key].mark_at) == (level, mark), key


DAY_CMD = st.tuples(
    st.integers(0, 3), st.sampled_from([ADD, TAKE, TAKE, SKIP]), st.integers(0, 9), st.one_of(st.none(), st.integers(1, 99))
)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.tuples(st.integers(0, 25), st.lists(DAY_CMD, min_size=1, max_size=14)), min_size=1, max_size=6))
def test_runs_and_replay_match_the_walk_with_integer_ids(spark, keys):
    """Positions pass 9 and 10, so an order by text would differ from that of the numbers."""
    keys = [(o, [(d, k, a, m if k == ADD else None) for d, k, a, m in sorted(cs, key=lambda c: c[0])]) for o, cs in keys]
    check_marked(spark, keys)


def test_one_key_holds_a_third_of_all_rows_with_shared_prefixes_and_cents(spark):
    rng = random.Random(11)

    def commands(n, days):
        cmds = []
        for day in range(days):
            for _ in range(n // days):
                kind = rng.choice([ADD, ADD, TAKE, TAKE, SKIP])
                cmds.append((day, kind, rng.randint(1, 250_000_00), rng.randint(1, 99) if kind == ADD and rng.random() < 0.3 else None))
        return cmds

    keys = [(rng.randint(0, 10**9), commands(60, 6)) for _ in range(60)] + [(10**11, commands(900, 30)), (5, commands(900, 1))]
    check_marked(spark, keys, "string", lambda pos: f"same-prefix-{pos:05d}")


def test_numeric_ids_decide_in_number_order(spark):
    """Stock 10, one day: id 9 takes 8 first, so id 10 (which wants 5) is rejected."""
    p = products_df(spark, [(1, 1, "A", "c", 1, 2, 10, 0)])
    cmds = spark.createDataFrame([(1, 1, 10, TODAY, 5), (1, 1, 9, TODAY, 8)], SALE_CMD.replace("id string", "id long"))
    assert {r.id: r.status for r in L.apply_sales(p, cmds).collect()} == {9: "accepted", 10: "rejected"}


@pytest.mark.parametrize("opening", [0, 3, 700, 10**6])
def test_replay_equals_the_walk_across_slices(opening):
    rng = random.Random(opening)
    for size in (0, 1, SLICE, SLICE + 1, 3 * SLICE + 7):
        cmds = [(rng.choice([ADD, TAKE, TAKE, SKIP]), rng.randint(0, 40)) for _ in range(size)]
        kinds, amounts = (np.array([c[i] for c in cmds], dtype=np.int64) for i in (0, 1))
        ok, after = replay(kinds, amounts, opening)
        assert list(zip(ok.tolist(), after.tolist())) == walk(opening, cmds)


def test_the_fold_evaluates_the_commands_once(spark):
    """Building the plan writes what the fold works on; nothing of the input is evaluated again by its result."""
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    p = products_df(spark, [(1, 1, "A", "c", 1, 2, 10, 0)])
    commands = spark.createDataFrame([(1, 1, f"x{i}", TODAY, 5) for i in range(7)], SALE_CMD)
    out = L.apply_sales(p, commands.mapInArrow(seen, SALE_CMD))
    assert out.where("status = 'accepted'").count() == 2 and out.count() == 7
    assert rows.value == 7


def _step_walk(level, rows):
    for kind, amount, extra in rows:
        if kind == ADD:
            level += amount
        elif kind == TAKE and amount + extra <= level:
            level -= amount
    return level


@settings(max_examples=200, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from([ADD, TAKE, TAKE, SKIP]), st.integers(0, 9), st.integers(0, 1)), max_size=90))
def test_step_functions_equal_the_walk_from_every_level(rows):
    kinds, amounts, extras = (np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))
    steps = run_steps(kinds, amounts, extras)
    assert steps.starts[0] == 0 and (np.diff(steps.starts) > 0).all()
    for level in [*range(60), 500, 10**12]:
        assert steps(level) == _step_walk(level, rows), level


@pytest.mark.parametrize("run_rows,partitions", [(1, 5), (3, 2), (7, 9), (512, 3)])
def test_one_key_on_one_day_is_cut_into_runs(spark, run_rows, partitions):
    """A hot key with a third of all rows, all on one day, besides short keys and keys that never fit."""
    rng = random.Random(run_rows)
    rows, expected = [], {}
    for k in range(40):
        n, opening = (400 if k == 7 else rng.randint(1, 25)), rng.randint(0, 60)
        level, mark = opening, None
        for pos in range(n):
            kind, a, extra = rng.choice([ADD, TAKE, TAKE, SKIP]), rng.randint(0, 30), rng.choice([0, 0, 1])
            m = rng.choice([None, None, pos]) if kind == ADD else None
            mark = mark if m is None else m
            ok = kind == ADD or (kind == TAKE and a + extra <= level)
            level += a if kind == ADD else -a if ok else 0
            expected[k, pos] = (ok, None if kind == SKIP else level, None if kind == SKIP else mark)
            rows.append((k, 1, pos, kind, a, extra, opening, m, None, f"{k}-{pos}"))
    rng.shuffle(rows)
    schema = "k long, day int, pos long, _kind int, _amount long, _extra long, _opening long, _mark long, _opening_mark long, sid string"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = greedy_fold(spark.createDataFrame(rows, schema), ["k"], ["day", "pos"], mark=True, spread="sid", run_rows=run_rows)
        got = {(r.k, r.pos): (r.accepted, r.level_after, r.mark_at) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected


def test_null_keys_and_empty_commands(spark):
    schema = "k long, pos long, _kind int, _amount long, _opening long, sid string"
    assert greedy_fold(spark.createDataFrame([], schema), ["k"], ["pos"], spread="sid").collect() == []
    rows = [(None, i, SKIP, 0, 0, f"n{i}") for i in range(50)] + [(1, 1, TAKE, 3, 3, "a"), (1, 2, TAKE, 1, 3, "b")]
    got = {r.sid: (r.accepted, r.level_after) for r in greedy_fold(spark.createDataFrame(rows, schema), ["k"], ["pos"], spread="sid").collect()}
    assert got == {f"n{i}": (False, None) for i in range(50)} | {"a": (True, 0), "b": (False, 0)}


@pytest.mark.parametrize("parts,run_rows", [(1, 512), (6, 4), (6, 512)])
def test_clustered_commands_are_walked_where_they_lie(spark, monkeypatch, parts, run_rows):
    """Keys that lie in one partition are dealt out no more; those that turn out to be split are, and the result is the walk's."""
    rng, frame = random.Random(parts), type(spark.range(1))
    rows, expected = [], {}
    for k in [None, *range(30)]:
        level, mark = rng.randint(0, 60), None
        opening = level
        for pos in range(90 if k == 7 else rng.randint(1, 12)):
            kind, a = SKIP if k is None else rng.choice([ADD, TAKE, TAKE, SKIP]), rng.randint(0, 30)
            m = rng.choice([None, pos]) if kind == ADD else None
            mark = mark if m is None else m
            ok = kind == ADD or (kind == TAKE and a <= level)
            level += a if kind == ADD else -a if ok else 0
            expected[k, pos] = (ok, None if kind == SKIP else level, None if kind == SKIP else mark)
            rows.append((k, pos, kind, a, opening, m, None))
    rng.shuffle(rows)
    commands = spark.createDataFrame(rows, "k long, pos long, _kind int, _amount long, _opening long, _mark long, _opening_mark long")
    dealt, deal = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda *a: dealt.append(1) or deal(*a))
    for together, df in (True, commands.repartition(parts, "k")), (parts == 1, commands.repartition(parts)):
        dealt.clear()
        out = greedy_fold(df, ["k"], ["pos"], mark=True, run_rows=run_rows, clustered=True)
        assert {(r.k, r.pos): (r.accepted, r.level_after, r.mark_at) for r in out.collect()} == expected
        assert bool(dealt) != together
