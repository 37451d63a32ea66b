"""Distributed positions, connected groups, ids without gaps, renames by group, time stamps, stored ledgers."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime

import pytest
from conftest import SF_SMALL, d, products_df
from pyspark.sql import functions as F

from tallyspark.operators import answers as A
from tallyspark.operators import ledger as L
from tallyspark.operators import order as O
from tallyspark.operators import stamps as ST
from tallyspark.operators.order import connected, numbered
from tallyspark.schemas import CUSTOMERS, DEBTS, PRODUCTS, SALES, SHOPS
from tallyspark.session import scratch_path
from tallyspark.sources import fixtures as fx
from tallyspark.sources import sinks
from tallyspark.sources.driver import DriverTables


@pytest.fixture
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_positions(spark, many_partitions, groups):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, 2]), rng.randint(0, 300), f"v{i}") for i in range(2500)]
    out = numbered(spark.createDataFrame(rows, "g long, k int, v string").repartition(6), ["k", "v"], "n", groups)
    assert out.columns == ["g", "k", "v", "n"]
    by = defaultdict(list)
    for r in out.collect():
        by[r.g if groups else 0].append((r.n, r.k, r.v))
    want = defaultdict(list)
    for g, k, v in rows:
        want[g if groups else 0].append((k, v))
    assert {g: [(k, v) for _, k, v in sorted(x)] for g, x in by.items()} == {g: sorted(x) for g, x in want.items()}
    assert all(sorted(n for n, *_ in x) == list(range(1, len(x) + 1)) for x in by.values())


def test_a_hot_group_is_ranked_in_many_tasks(spark, many_partitions):
    """Every row of one shop: no partition of the ranking holds more than a small multiple of its share."""
    df = spark.range(0, 13_000, 1, 5).select(F.lit(1).alias("shop"), (F.col("id") * 7919 % 13_000).alias("k"))
    out = numbered(df, ["k"], "n", ["shop"])
    assert out.where(F.col("n") != F.col("k") + 1).count() == 0
    sizes = [r["count"] for r in out.groupBy(F.floor(F.col("n") / 1000)).count().collect()]
    assert len(sizes) >= 13


@pytest.mark.parametrize("seed", range(3))
def test_connected_groups(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5)]
    links += [(300, 300 + i) for i in range(40)]  # a star, and the path above
    group = {n: n for link in links for n in link}

    def root(n):
        while group[n] != n:
            n = group[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    got = {r.node: r.group for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in group}


def test_connected_without_links(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_ids_have_no_gaps(spark):
    products = products_df(spark, [(1, 40, "A", "c", 1, 2, 1, 1), (2, 7, "B", "c", 1, 2, 1, 1)])
    rows = [(1, 900, "x"), (1, 5, "a"), (2, 17, "y"), (1, 300, ""), (2, 800, "Y"), (2, 1000, "z")]
    requests = spark.createDataFrame([(s, q, n, "c", d(1), d(2), 1, 1) for s, q, n in rows],
                                     "shop_id long, seq long, name string, category string, buy_price decimal(12,2), "
                                     "sell_price decimal(12,2), stock_quantity int, low_stock_threshold int")  # fmt: skip
    got = sorted((r.id, r.shop_id, r.name) for r in L.insert_products(products, requests).collect())
    assert got == [(41, 2, "y"), (42, 1, "x"), (43, 2, "z")]
    customers = spark.createDataFrame([(1, 3, "Amal", None)], CUSTOMERS)
    debts = [(1, 70, "New", 1.0), (1, 20, "amal", 1.0), (2, 50, "Other", 1.0), (1, 60, "NEW ", 1.0), (1, 55, "bad", 0.0)]
    debts = spark.createDataFrame([(s, q, n, None, a, None, date(2024, 1, 1)) for s, q, n, a in debts],
                                  "shop_id long, seq long, customer_name string, phone string, amount double, note string, command_date date")
    after = sorted((r.id, r.shop_id, r.name) for r in L.upsert_customers(customers, debts).collect())
    assert after == [(3, 1, "Amal"), (4, 2, "Other"), (5, 1, "NEW")]
    assert {r.id: r.customer_id for r in L.apply_debts(customers, debts).collect()} == {70: 5, 20: 3, 50: 4, 60: 5, 55: None}
    shops = spark.createDataFrame([(9, "S", 1)], SHOPS)
    profiles = spark.createDataFrame([(1, 9, "N", "owner")], "id long, shop_id long, full_name string, role string")
    asked = spark.createDataFrame([(2, 30, "T", "x"), (3, 10, " ", "x"), (4, 20, "U", "x"), (1, 5, "V", "x")],
                                  "user_id long, seq long, shop_name string, full_name string")
    assert {r.user_id: r.shop_id for r in L.onboard_shops(shops, profiles, asked).collect()} == {1: None, 2: 11, 3: None, 4: 10}


UPDATE = (
    "shop_id long, id long, command_date date, command_id long, name string, category string, buy_price decimal(12,2), "
    "sell_price decimal(12,2), stock_quantity int, low_stock_threshold int"
)


@pytest.mark.parametrize("seed", range(4))
def test_renames_by_group_equal_one_after_the_other(spark, seed):
    """One shop with nearly all renames, chains and swaps, invalid commands on others' names."""
    rng = random.Random(seed)
    products = [(1, i, f"n{i}") for i in range(40)] + [(2, i, f"n{i}") for i in range(5)]
    cmds = []
    for c in range(220):
        shop = 2 if c % 20 == 0 else 1
        name = rng.choice([f"N{rng.randrange(60)}", f" n{rng.randrange(40)} ", f"new{rng.randrange(12)}"])
        cmds.append((shop, rng.randrange(43), date(2024, 1, 1 + c // 50), rng.randrange(10**6), name, rng.choice([1, 1, 1, -1])))
    cmds = list({(x[2], x[3]): x for x in cmds}.values())
    held = {(s, i): n for s, i, n in products}
    want = {}
    for shop, i, day, cid, name, price in sorted(cmds, key=lambda x: (x[2], x[3])):
        key, reasons = name.strip().lower(), []
        if price < 0:
            reasons.append("negative_price")
        if (shop, i) not in held:
            reasons.append("not_found")
        if any(s == shop and n == key and p != i for (s, p), n in held.items()):
            reasons.append("duplicate_name")
        if not reasons:
            held[shop, i] = key
        want[day, cid] = ";".join(reasons)
    p = products_df(spark, [(s, i, n, "c", 1, 2, 1, 1) for s, i, n in products])
    u = spark.createDataFrame([(s, i, day, cid, n, "c", d(pr), d(1), 1, 1) for s, i, day, cid, n, pr in cmds], UPDATE).repartition(4)
    got = {(r.command_date, r.command_id): r.reasons for r in L.update_outcomes(p, u).collect()}
    assert got == want
    names = {(r.shop_id, r.id): r.name.strip().lower() for r in L.update_products(p, u).collect()}
    assert names == held


def test_low_stock_list_in_parts_and_equal_items(spark, monkeypatch):
    monkeypatch.setattr(A, "PART_ITEMS", 7)
    rows = [(1, i, "same" if i % 3 else f"p{i:02}", "c", 1, 2, i % 4, 9) for i in range(30)] + [(3, 99, "x", "c", 1, 2, 50, 1)]
    shops = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], SHOPS)
    got = {(r.shop_id, r.part): r.answer for r in A.answer_low_stock(shops, products_df(spark, rows)).collect()}
    items = [f"{n} ({q} left)" for q, n in sorted((r[6], r[2]) for r in rows[:30])]
    want = {(1, k): A.LOW_STOCK_PREFIX + A.ITEM_SEPARATOR.join(items[7 * k : 7 * k + 7]) + "." for k in range(5)}
    assert got == want | {(2, 0): A.LOW_STOCK_EMPTY, (3, 0): A.LOW_STOCK_EMPTY}


def test_equal_items_do_not_pass_a_lists_cap(spark):
    """Twelve debtors of one name and balance: the list shows eight."""
    shops = spark.createDataFrame([(1, "a", 1)], SHOPS)
    customers = spark.createDataFrame([(1, i, "Twin", None) for i in range(12)], CUSTOMERS)
    debts = spark.createDataFrame([(1, i, i, "Twin", "debt", d(5), None, date(2024, 1, 1)) for i in range(12)], DEBTS)
    sales = spark.createDataFrame([], SALES)
    out = A.answer_table(shops, spark.createDataFrame([], PRODUCTS), sales, customers, debts, date(2024, 1, 2)).collect()
    answer = {r.intent: r.answer for r in out}
    assert answer[A.DEBTORS] == A.DEBTORS_PREFIX + A.ITEM_SEPARATOR.join(["Twin (5.00 MAD)"] * 8) + "."
    assert answer[A.UNPAID].startswith(A.UNPAID_PREFIX + "60.00") and len(out) == 7


def test_stamps(spark):
    first, then = datetime(2024, 1, 1), datetime(2024, 5, 6, 7, 8, 9)
    before = ST.first_stamps(spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "s long, id long, v string"), first)
    after = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "s long, id long, v string")
    touched = spark.createDataFrame([(1, 2), (1, 2), (7, 7)], "s long, id long")
    got = ST.restamp(before, after, ["s", "id"], touched, then)
    assert {(r.id, r.v, r.created_at, r.updated_at) for r in got.collect()} == {(1, "a", first, first), (2, "b", first, then), (3, "c", then, then)}
    assert got.schema[-2:] == got.schema[-2:] and [f.dataType for f in got.schema[-2:]] == [f.dataType for f in ST.STAMPS]


def _ledger(spark, n=400):
    rows = [(1 if i % 3 else 2 + i % 50, f"s{i}", i % 9, f"p{i % 9}", 1, date(2024, 1 + i % 6, 1), None, None) for i in range(n)]
    return spark.createDataFrame(rows, SALES), rows


def test_deletes_on_a_stored_ledger_rewrite_their_buckets_only(spark):
    path = scratch_path(spark, "stored-ledger")
    sales, rows = _ledger(spark)
    by = ["shop_id", "sale_date", "id"]
    before = sinks.write_buckets(spark, sales, path, ["shop_id"], by, 16)
    products = products_df(spark, [(5, 0, "p", "c", 1, 2, 1, 1), (5, 3, "p", "c", 1, 2, 1, 1), (8, 6, "q", "c", 1, 2, 1, 1)])
    deletes = spark.createDataFrame([(5, 0), (5, 3), (5, 77), (2, 1)], "shop_id long, id long")
    after = L.null_refs_stored(spark, path, SALES, products, deletes, by)
    moved = {b for b in before["base"] if before["base"][b] != after["base"].get(b)}
    assert len(moved) == 1 and set(after["base"]) == set(before["base"])  # only shop 5 has deleted products
    got = {r.id: r.product_id for r in sinks.read_snapshot(spark, path, SALES).collect()}
    assert got == {i: None if s == 5 and p in (0, 3) else p for s, i, p, *_ in rows}
    assert {r.id: r.product_id for r in sinks.read_snapshot(spark, path, SALES, before).collect()} == {r[1]: r[2] for r in rows}
    nothing = L.null_refs_stored(spark, path, SALES, products, deletes.limit(0), by)
    assert nothing["base"] == after["base"]


def test_customer_cascade_on_a_stored_ledger(spark):
    path = scratch_path(spark, "stored-debts")
    rows = [(1 + i % 20, i, i % 4, "x", "debt", d(1), None, date(2024, 1, 1)) for i in range(200)]
    by = ["shop_id", "transaction_date", "id"]
    before = sinks.write_buckets(spark, spark.createDataFrame(rows, DEBTS), path, ["shop_id"], by, 16)
    gone = spark.createDataFrame([(3, k) for k in range(4)] + [(4, 1)], "shop_id long, id long")
    after = L.cascade_customers_stored(spark, path, DEBTS, gone, by)
    assert len({b for b in before["base"] if before["base"][b] != after["base"].get(b)}) <= 2
    got = {r.id for r in sinks.read_snapshot(spark, path, DEBTS).collect()}
    assert got == {i for s, i, c, *_ in rows if not (s == 3 or (s == 4 and c == 1))}


@pytest.mark.parametrize("few", [True, False])
def test_few_deleted_products_deal_no_rows_out_again(spark, monkeypatch, few):
    """The rewrite that nulls references shuffles nothing where the deleted keys are few; its rows are the same otherwise."""
    t = DriverTables(spark, SF_SMALL)
    path, by = scratch_path(spark, "null-refs"), ["shop_id", "sale_date", "id"]
    sinks.write_buckets(spark, fx.sales(t), path, ["shop_id"], by, 4)
    dealt, deal = [], type(spark.range(1)).repartitionByRange
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda *a: dealt.append(1) or deal(*a))
    if not few:
        monkeypatch.setattr(L, "FEW_KEYS", 0)
    L.null_refs_stored(spark, path, SALES, fx.products(t), fx.discontinued_products(t), by)
    assert bool(dealt) != few
    want = L.null_deleted_refs(fx.sales(t), fx.products(t), fx.discontinued_products(t))
    got = sinks.read_snapshot(spark, path, SALES)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_timeline_rows_carry_only_what_is_asked_for(spark, monkeypatch):
    """The stock after the timeline needs no names, prices or suppliers of its commands; only sales carry names."""
    t, seen = DriverTables(spark, SF_SMALL), []
    monkeypatch.setattr(L, "greedy_fold", lambda cmds, *a, **k: seen.append(cmds) or cmds.selectExpr("*", "true as accepted", "1L as level_after", "1L as mark_at"))
    L.timeline_stock(fx.products(t), fx.sale_commands(t), fx.restock_commands(t))
    L.apply_stock_timeline(fx.products(t), fx.sale_commands(t), fx.restock_commands(t))
    assert not {"product_name", "sell_price", "supplier_name"} & set(seen[0].columns)
    assert seen[1].where("_rank = 0 and product_name is not null").isEmpty()
    assert not seen[1].where("_rank = 1 and product_name is not null").isEmpty()


def test_stamps_resolve_the_updates_once(spark, monkeypatch):
    calls, outcomes = [], L.update_outcomes
    monkeypatch.setattr(L, "update_outcomes", lambda *a: calls.append(1) or outcomes(*a))
    from tallyspark.plans import QUERIES

    QUERIES["update_products_stamps"](spark, SF_SMALL)
    assert len(calls) == 1


def test_stamps_write_the_commands_once(spark, monkeypatch):
    """The commands and their verdicts are written; the outcomes, which hold no more, are not written beside them."""
    written, path = [], O.scratch_path
    monkeypatch.setattr(O, "scratch_path", lambda spark, name: written.append(name) or path(spark, name))
    from tallyspark.plans import QUERIES

    QUERIES["update_products_stamps"](spark, SF_SMALL)
    assert written.count("updates") == 1 and "outcomes" not in written


def test_update_verdicts_take_one_join_of_whole_commands(spark):
    """Verdicts of names that nobody moves come from the replay, too: the commands' other columns are not dealt out by name."""
    p = products_df(spark, [(1, i, n, "c", 1, 2, 3, 4) for i, n in [(1, "a"), (2, " A"), (3, "b"), (4, "d")]])
    names = [(1, "a"), (3, "B "), (3, None), (4, "b"), (4, "a"), (9, "b"), (9, "new"), (None, "b")]
    rows = [(1, i, date(1998, 6, 12), k, n, "c", d(1), d(2), 3, 4) for k, (i, n) in enumerate(names)]
    out = L.update_outcomes(p, spark.createDataFrame(rows, UPDATE))
    got = [r.reasons for r in sorted(out.collect(), key=lambda r: r.command_id)]
    twice = "duplicate_name"
    assert got == [twice, "", "name_required", twice, twice, f"not_found;{twice}", "not_found", "not_found"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


@pytest.mark.parametrize("few", [True, False])
def test_flags_come_back_by_position(spark, monkeypatch, few):
    """Positions of several files and bitmaps, at their borders, with bitmaps held by every task or joined."""
    if not few:
        monkeypatch.setattr(O, "FEW_BLOCKS", 0)
    at = [p + n for p in (0, 1 << 33, 5 << 33) for n in (0, 1, 7, 8, 63, 32767, 32768, 99999)]
    hits = {a: (i % 2 == 0, i % 5 == 0) for i, a in enumerate(at) if i % 3}
    df = spark.createDataFrame([(a, f"r{a}") for a in at], "_at long, name string")
    found = spark.createDataFrame([(a, *f) for a, f in hits.items()], "_at long, x boolean, y boolean")
    out = O.marked(df, "_at", found, "x", "y")
    assert out.columns == ["_at", "name", "x", "y"]
    assert {r._at: (r.x, r.y) for r in out.collect()} == {a: hits.get(a, (False, False)) for a in at}


def test_update_commands_are_not_dealt_out_whole(spark):
    """Verdicts go back to the commands as bitmaps: no shuffle holds what a command carries."""
    t, names = DriverTables(spark, SF_SMALL), ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    try:
        out = L.update_outcomes(fx.products(t), fx.product_updates(t))
        # the names asked for with those that are replayed; whole commands meet the bitmaps
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
        assert out.count() == fx.product_updates(t).count()
        after = L.update_products(fx.products(t), fx.product_updates(t))
        # and the products with each one's last command
        assert after._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin") == 2
    finally:
        for name in names:
            spark.conf.unset(name)


def test_a_product_without_a_name_can_be_updated(spark):
    """It is found, gets its name by the update and keeps it from others, as in the SQL."""
    p = spark.createDataFrame([(1, 1, None, "c", d(1), d(2), 3, 4), (1, 2, "b", "c", d(1), d(2), 3, 4)], PRODUCTS)
    rows = [(1, i, date(1998, 6, 12), k, n, "c", d(1), d(2), 3, 4) for k, (i, n) in enumerate([(2, "a"), (1, "A"), (1, "b"), (2, " B")])]
    out = L.update_outcomes(p, spark.createDataFrame(rows, UPDATE), ["command_id"])
    assert [tuple(r) for r in out.sort("command_id").collect()] == [(0, "", True), (1, "duplicate_name", False), (2, "", True), (3, "duplicate_name", False)]


def test_the_timeline_deals_its_commands_out_once(spark, monkeypatch):
    """The join with the products leaves the commands of a product together: the fold needs no shuffle of its own."""
    t, frame = DriverTables(spark, SF_SMALL), type(spark.range(1))
    dealt, deal = [], frame.repartitionByRange
    monkeypatch.setattr(frame, "repartitionByRange", lambda *a: dealt.append(1) or deal(*a))
    rows = L.apply_stock_timeline(fx.products(t), fx.sale_commands(t), fx.restock_commands(t))
    assert rows.count() == fx.sale_commands(t).count() and not dealt
    left = L.timeline_stock(fx.products(t), fx.sale_commands(t), fx.restock_commands(t))
    assert left.count() == fx.products(t).count() and not dealt
