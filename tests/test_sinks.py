"""Sinks: month-partitioned ledger append, versioned snapshots, CSV quoting."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from tallyspark.schemas import CUSTOMERS, PRODUCTS, SALES
from tallyspark.session import scratch_path
from tallyspark.sources import fixtures as fx
from tallyspark.sources import sinks
from tallyspark.sources.driver import DriverTables


def test_ledger_append_by_month(spark):
    t = DriverTables(spark, SF_SMALL)
    path = scratch_path(spark, "ledger")
    sales = fx.sales(t)
    n = sales.count()
    sinks.write_ledger(sales, path, "sale_date")
    sinks.write_ledger(sales.limit(5), path, "sale_date")
    back = spark.read.parquet(path)
    assert back.count() == n + 5 == sinks.read_ledger(spark, path, SALES, "sale_date").count()
    months = {r.month for r in back.select("month").distinct().collect()}
    assert all(len(m) == 7 and m[4] == "-" for m in months)


def test_snapshot_versions_and_meta(spark):
    path = scratch_path(spark, "snap")
    assert sinks.read_snapshot(spark, path, PRODUCTS).count() == 0
    rows = [(1, 1, "A", "c", None, None, 1, 1)]
    v1 = sinks.write_snapshot(spark, spark.createDataFrame(rows, PRODUCTS), path, {"batch_id": 0})
    v2 = sinks.write_snapshot(spark, spark.createDataFrame(rows * 2, PRODUCTS), path)
    assert v1 != v2 and sinks.current_version(spark, path) == v2
    assert sinks.read_snapshot(spark, path, PRODUCTS).count() == 2
    assert sinks.snapshot_meta(spark, path)["seq"] == 2


def test_csv_quotes_and_empty_text(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame([(1, 1, 'Say "hi", please', ""), (1, 2, "plain", None)], CUSTOMERS)
    sinks.write_csv(df, path)
    text = "".join(r.value + "\n" for r in spark.read.text(path).collect())
    assert '"Say ""hi"", please"' in text
    back = {r.id: r for r in sinks.read_csv(spark, path, CUSTOMERS).collect()}
    assert back[1].name == 'Say "hi", please' and back[2].phone is None


def test_a_commit_on_an_old_base_raises(spark):
    path = scratch_path(spark, "lost-update")
    row = lambda q: spark.createDataFrame([(1, 1, "A", "c", None, None, q, 1)], PRODUCTS)
    sinks.write_snapshot(spark, row(1), path)
    seen_by_a = seen_by_b = sinks.snapshot_meta(spark, path)
    sinks.write_snapshot(spark, row(2), path, base=seen_by_b)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        sinks.write_snapshot(spark, row(3), path, base=seen_by_a)
    assert sinks.read_snapshot(spark, path, PRODUCTS).collect()[0].stock_quantity == 2


def test_a_replayed_batch_replaces_its_own_rows_only(spark):
    t = DriverTables(spark, SF_SMALL)
    path = scratch_path(spark, "replay")
    sales = fx.sales(t)
    sinks.write_ledger(sales.limit(7), path, "sale_date", batch_id=1)
    for _ in range(2):
        sinks.write_ledger(sales.limit(5), path, "sale_date", batch_id=2)
    assert sinks.read_ledger(spark, path, SALES, "sale_date").count() == 12


def test_create_then_reset_tables(spark):
    t = DriverTables(spark, SF_SMALL)
    root = scratch_path(spark, "tables")
    sinks.create_tables(spark, root)
    for name, schema in sinks.table_schemas().items():
        df = sinks.read_table(spark, root, name)
        assert df.count() == 0 and df.columns == schema.names
    sinks.reset_tables(spark, root, {"products": fx.products(t), "sales": fx.sales(t)})
    sinks.create_tables(spark, root)  # a second create keeps the data
    assert sinks.read_table(spark, root, "products").count() == fx.products(t).count()
    assert sinks.read_table(spark, root, "sales").count() == fx.sales(t).count()
    sinks.append_rows(spark, root, "sales", fx.sales(t).limit(4), batch_id=1)
    assert sinks.read_table(spark, root, "sales").count() == fx.sales(t).count() + 4
    sinks.reset_tables(spark, root, {"sales": fx.sales(t).limit(3)})
    assert sinks.read_table(spark, root, "sales").count() == 3


def test_the_stream_runs_on_created_tables(spark):
    from tallyspark.streaming import ingest as I

    t = DriverTables(spark, SF_SMALL)
    root = scratch_path(spark, "stream-tables")
    sinks.create_tables(spark, root)
    sinks.reset_tables(spark, root, {"products": fx.products(t)})
    cmds = fx.sale_commands(t).select(
        F.lit(I.SALE).alias("kind"), *I.SALE_COLUMNS, F.lit(None).cast("string").alias("supplier_name"),
        F.lit(None).cast("decimal(12,2)").alias("unit_buy_price"), F.lit(None).cast("boolean").alias("update_buy_price"),
    )
    assert I.apply_command_batch(spark, cmds, 0, f"{root}/products", f"{root}/ledger")
    assert I.ledger(spark, f"{root}/ledger", "sales").count() > 0


def test_read_ledger_prunes_month_folders(spark):
    from datetime import date as _date

    from tallyspark.schemas import SALES

    t = DriverTables(spark, SF_SMALL)
    path = scratch_path(spark, "ledger-read")
    sinks.write_ledger(fx.sales(t), path, "sale_date")
    start, end = _date(1998, 6, 6), fx.TODAY
    df = sinks.read_ledger(spark, path, SALES, "sale_date", start, end)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "1998-06" in plan
    want = fx.sales(t).where(f"sale_date BETWEEN DATE'{start}' AND DATE'{end}'").count()
    assert df.count() == want > 0
    assert df.columns == [f.name for f in SALES.fields]


def test_report_over_written_ledger_equals_direct(spark):
    from datetime import timedelta

    from tallyspark.operators import reports as R
    from tallyspark.schemas import SALES

    t = DriverTables(spark, SF_SMALL)
    path = scratch_path(spark, "ledger-report")
    sinks.write_ledger(fx.sales(t), path, "sale_date")
    window = sinks.read_ledger(spark, path, SALES, "sale_date", fx.TODAY - timedelta(days=6), fx.TODAY)
    direct = R.restock_recommendations(fx.products(t), fx.sales(t), fx.TODAY)
    stored = R.restock_recommendations(fx.products(t), window, fx.TODAY)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, stored.collect()))


KEYS = ["shop_id", "id"]


def _products(spark, ids, stock):
    return spark.createDataFrame([(1, i, f"p{i}", "c", None, None, stock, 1) for i in ids], PRODUCTS)


def _stock(df):
    return {r.id: r.stock_quantity for r in df.collect()}


def _written(spark, path):
    """Rows and folders of a table, as the file system has them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return {r.path.split("/")[-2] if "_bucket=" not in r.path else "/".join(r.path.split("/")[-3:-1]) for r in files.select("path").collect()}


def test_deltas_compaction_and_old_versions(spark):
    path = scratch_path(spark, "deltas")
    sinks.write_snapshot(spark, _products(spark, range(200), 5), path)
    first = sinks.snapshot_meta(spark, path)
    sinks.update_snapshot(spark, _products(spark, [3, 4, 500], 9), path, KEYS, buckets=32)
    sinks.update_snapshot(spark, _products(spark, [4, 5], 7), path, KEYS, gone=F.col("id") == 5)
    want = {i: 5 for i in range(200) if i != 5} | {3: 9, 4: 7, 500: 9}
    second = sinks.snapshot_meta(spark, path)
    assert _stock(sinks.read_snapshot(spark, path, PRODUCTS)) == want
    assert _stock(sinks.read_snapshot(spark, path, PRODUCTS, first)) == {i: 5 for i in range(200)}  # as of a version
    # the first compaction cuts the base into buckets; the next one rewrites the touched buckets only
    sinks.compact_snapshot(spark, path, PRODUCTS)
    third = sinks.snapshot_meta(spark, path)
    assert not third["deltas"] and len(third["base"]) <= 32
    sinks.update_snapshot(spark, _products(spark, [7], 1), path, KEYS)
    sinks.update_snapshot(spark, _products(spark, [8], 0), path, KEYS, gone=F.lit(True))
    want = {**want, 7: 1}
    del want[8]
    assert sinks.compact_snapshot(spark, path, PRODUCTS, max_deltas=2)["deltas"]  # few deltas: nothing to do
    fourth = sinks.compact_snapshot(spark, path, PRODUCTS)
    moved = {b for b, f in fourth["base"].items() if third["base"].get(b) != f}
    assert 1 <= len(moved) <= 2 and not fourth["deltas"]
    for meta in (fourth, sinks.LATEST):
        assert _stock(sinks.read_snapshot(spark, path, PRODUCTS, meta)) == want
    # a reader that holds an earlier version still sees it, until it is removed
    assert _stock(sinks.read_snapshot(spark, path, PRODUCTS, second))[8] == 5
    sinks.remove_old_versions(spark, path, keep=1)
    assert _stock(sinks.read_snapshot(spark, path, PRODUCTS)) == want
    assert [m["seq"] for m in sinks._pointers(spark, path)] == [fourth["seq"]]
    kept = {f"{f}/_bucket={b}" for b, f in fourth["base"].items()}
    assert _written(spark, path) - kept <= {x for x in _written(spark, path) if "/_bucket=" in x}


@pytest.mark.parametrize("bucketed", [False, True])
def test_only_the_buckets_of_some_keys(spark, bucketed):
    path = scratch_path(spark, "only")
    sinks.update_snapshot(spark, _products(spark, range(300), 5), path, KEYS, buckets=64)
    if bucketed:
        sinks.compact_snapshot(spark, path, PRODUCTS)
    sinks.update_snapshot(spark, _products(spark, [10, 11, 900], 8), path, KEYS)
    keys = spark.createDataFrame([(1, 10), (1, 900), (None, 7)], "shop_id long, id long")
    part = sinks.read_snapshot(spark, path, PRODUCTS, only=keys)
    got = _stock(part)
    assert got[10] == got[900] == 8 and len(got) < 60
    if bucketed:
        files = {f.rsplit("/", 1)[0] for f in part.inputFiles()}
        assert len([f for f in files if "_bucket=" in f]) <= 3
    whole = _stock(sinks.read_snapshot(spark, path, PRODUCTS))
    assert all(whole[i] == q for i, q in got.items()) and len(whole) == 301


def test_a_small_batch_writes_a_small_part(spark):
    path = scratch_path(spark, "small-part")
    n = 50_000
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("shop_id"), "id", F.concat(F.lit("p"), "id").alias("name"), F.lit("c").alias("category"),
        F.lit(None).cast("decimal(12,2)").alias("buy_price"), F.lit(None).cast("decimal(12,2)").alias("sell_price"),
        F.lit(5).alias("stock_quantity"), F.lit(1).alias("low_stock_threshold"),
    )
    sinks.update_snapshot(spark, rows, path, KEYS)
    sinks.compact_snapshot(spark, path, PRODUCTS)
    one_percent = rows.where(F.col("id") % 100 == 3).withColumn("stock_quantity", F.lit(6))
    meta = sinks.update_snapshot(spark, one_percent, path, KEYS)
    delta = spark.read.parquet(f"{path}/{meta['deltas'][0]}")
    assert delta.count() == n // 100 and len(meta["deltas"]) == 1
    now = sinks.read_snapshot(spark, path, PRODUCTS)
    assert now.count() == n and now.where("stock_quantity = 6").count() == n // 100


def test_commit_map_keeps_streams_apart(spark):
    path = scratch_path(spark, "streams")
    sinks.update_snapshot(spark, _products(spark, [1], 1), path, KEYS, {"batch_id": 4, "stream": "a"})
    base = sinks.snapshot_meta(spark, path)
    sinks.update_snapshot(spark, _products(spark, [2], 1), path, KEYS, {"batch_id": 0, "stream": "b"}, base=base)
    with pytest.raises(sinks.CommitConflict):
        sinks.update_snapshot(spark, _products(spark, [3], 1), path, KEYS, {"batch_id": 5, "stream": "a"}, base=base)
    now = sinks.snapshot_meta(spark, path)
    assert now["batches"] == {"a": 4, "b": 0}
    assert sinks.applied(now, "a", 4) and not sinks.applied(now, "a", 5) and not sinks.applied(now, "b", 1)
    assert not sinks.applied(now, "c", 0) and not sinks.applied(None, "a", 0)
    sinks.compact_snapshot(spark, path, PRODUCTS)
    assert sinks.snapshot_meta(spark, path)["batches"] == {"a": 4, "b": 0}


def test_two_streams_with_the_same_batch_id_keep_their_rows(spark):
    t = DriverTables(spark, SF_SMALL)
    path = scratch_path(spark, "two-streams")
    sales = fx.sales(t)
    for stream in ("a", "b", "a"):
        sinks.write_ledger(sales.limit(6), path, "sale_date", batch_id=1, stream=stream)
    assert sinks.read_ledger(spark, path, SALES, "sale_date").count() == 12
    sinks.drop_batch(spark, path, 1, "a")
    assert sinks.read_ledger(spark, path, SALES, "sale_date").count() == 6


def test_a_pointer_folder_of_a_dead_writer_does_not_block(spark):
    path = scratch_path(spark, "dead-pointer")
    sinks.update_snapshot(spark, _products(spark, [1], 1), path, KEYS)
    spark.createDataFrame([("x",)], "note string").write.text(f"{path}/{sinks.POINTERS}/{2:020d}/_temporary/0")
    assert sinks.snapshot_meta(spark, path)["seq"] == 1
    sinks.update_snapshot(spark, _products(spark, [2], 1), path, KEYS)
    assert sinks.snapshot_meta(spark, path)["seq"] == 2
    assert _stock(sinks.read_snapshot(spark, path, PRODUCTS)) == {1: 1, 2: 1}
