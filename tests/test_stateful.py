"""ST1 with levels in the state store: equal to the batch fold over restarts, nothing rewritten, odd commands."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_streaming import CUT, _commands, _rows

from tallyspark.operators import ledger as L
from tallyspark.schemas import CUSTOMERS, DEBTS, PRODUCTS, RESTOCKS, SALES
from tallyspark.session import scratch_path
from tallyspark.sources import fixtures as fx
from tallyspark.sources.driver import DriverTables
from tallyspark.streaming import ingest as I
from tallyspark.streaming import stateful as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(autouse=True)
def state_store(spark):
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, S.ROCKSDB)
    yield
    spark.conf.set(PROVIDER, before)


def _typed(df, schema):
    return df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def _folders(spark, base):
    return [f"{base}/{n}" for n in ("source", "ledger", "checkpoint")]


def test_stock_stream_equals_the_batch_over_a_restart(spark):
    t = DriverTables(spark, SF_SMALL)
    src, led, ckpt = _folders(spark, scratch_path(spark, "stateful-stock"))
    products, cmds = fx.products(t), _commands(t)
    cmds.where(F.col("command_date") < F.lit(CUT)).write.parquet(f"{src}/a")
    S.start_stock_stream(spark, src, products, led, ckpt, available_now=True).awaitTermination(300)
    cmds.where(F.col("command_date") >= F.lit(CUT)).write.parquet(f"{src}/b")
    q = S.start_stock_stream(spark, src, products, led, ckpt, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None

    sales, restocks = I.split_commands(cmds)
    outcomes = L.apply_stock_timeline(products, sales, restocks)
    assert _rows(I.ledger(spark, led, "sales")) == _rows(_typed(outcomes.where(F.col("status") == L.ACCEPTED), SALES)) != []
    assert _rows(I.ledger(spark, led, "restocks")) == _rows(_typed(L.apply_restocks(products, restocks), RESTOCKS)) != []
    rejects = spark.read.parquet(f"{led}/rejects/stock")
    refused = outcomes.where(F.col("status") != L.ACCEPTED).select("shop_id", "id", "reason")
    assert _rows(rejects.where("kind = 'sale'").select("shop_id", "id", "reason")) == _rows(refused) != []
    bad = L.validate_restocks(products, restocks).where(~F.col("accepted")).select("shop_id", "id", F.col("reasons").alias("reason"))
    assert _rows(rejects.where("kind = 'restock'").select("shop_id", "id", "reason")) == _rows(bad)

    # the state, read back as a table, is the stock after the timeline
    want = L.timeline_stock(products, sales, restocks).select(
        "shop_id", F.col("id").alias("product_id"), F.col("stock_quantity").cast("long"), (F.col("buy_price") * 100).cast("long")
    )
    got = S.levels(spark, ckpt).select("shop_id", "product_id", "stock", "buy_cents")
    known = "buy_cents is not null"
    assert _rows(got.where(known)) == _rows(want.toDF(*got.columns).where(known)) != []


def test_balance_stream_equals_the_batch_over_a_restart(spark):
    t = DriverTables(spark, SF_SMALL)
    src, led, ckpt = _folders(spark, scratch_path(spark, "stateful-credit"))
    customers = fx.customers(t)
    cmds = _typed(fx.credit_commands(t), I.CREDIT_COMMANDS)
    cut = F.lit(date(1995, 1, 1))
    cmds.where(F.col("transaction_date") < cut).write.parquet(f"{src}/a")
    S.start_balance_stream(spark, src, customers, None, led, ckpt, available_now=True).awaitTermination(300)
    cmds.where(F.col("transaction_date") >= cut).write.parquet(f"{src}/b")
    q = S.start_balance_stream(spark, src, customers, None, led, ckpt, available_now=True)
    q.awaitTermination(300)
    assert q.exception() is None
    outcomes = L.apply_payments(customers, cmds)
    accepted = outcomes.where(F.col("status") == L.ACCEPTED)
    assert _rows(I.ledger(spark, led, "debt_transactions")) == _rows(_typed(accepted, DEBTS)) != []
    rejects = spark.read.parquet(f"{led}/rejects/credit").select("shop_id", "id", "reason")
    assert _rows(rejects) == _rows(outcomes.where(F.col("status") != L.ACCEPTED).select("shop_id", "id", "reason"))
    signed = L.signed_amount(F.col("amount").cast("decimal(12,2)"), F.col("transaction_type"))
    want = accepted.groupBy("shop_id", "customer_id").agg((F.sum(signed) * 100).cast("long").alias("owed"))
    got = S.levels(spark, ckpt).where("owed <> 0").select("shop_id", "customer_id", "owed")
    assert _rows(got) == _rows(want.where("owed <> 0"))


def test_arrival_order_opening_levels_and_commands_without_a_key(spark):
    src, led, ckpt = _folders(spark, scratch_path(spark, "stateful-odd"))
    money = Decimal("2.00")
    products = spark.createDataFrame([(1, 1, "A", "c", money, Decimal("3.00"), 5, 1), (1, 2, "B", "c", None, None, None, 1)], PRODUCTS)

    def add(name, rows):
        spark.createDataFrame(rows, I.COMMANDS).coalesce(1).write.parquet(f"{src}/{name}")
        q = S.start_stock_stream(spark, src, products, led, ckpt, available_now=True)
        q.awaitTermination(300)
        assert q.exception() is None

    day = date(2024, 1, 1)
    add("a", [
        ("sale", 1, 1, "s1", day, 6, None, None, None), ("restock", 1, 1, "r1", day, 4, " x ", Decimal("2.50"), True),
        ("sale", 1, None, "s2", day, 1, None, None, None), ("sale", 1, 99, "s3", day, 1, None, None, None),
        ("restock", 1, 2, "r2", day, 3, "x", money, False), ("sale", 1, 2, "s4", day, None, None, None, None),
    ])
    add("b", [("sale", 1, 1, "s0", date(2020, 1, 1), 6, None, None, None), ("sale", 1, 1, "s5", None, 10, None, None, None)])
    rows = spark.read.parquet(f"{led}/outcomes/stock")
    got = {r.id: (r.status, r.reason, r.level_after) for r in rows.collect()}
    # r1 comes before s1 on one day (by id); the late s0 is applied when it arrives
    assert got == {
        "s1": ("accepted", "", 3), "r1": ("accepted", "", 9), "s2": ("rejected", "product_not_found", None),
        "s3": ("rejected", "product_not_found", None), "r2": ("accepted", "", 3), "s4": ("rejected", "quantity_not_positive", 3),
        "s0": ("rejected", "insufficient_stock", 3), "s5": ("rejected", "insufficient_stock", 3),
    }
    sale = I.ledger(spark, led, "sales").collect()
    assert [(r.id, r.revenue, r.profit) for r in sale] == [("s1", Decimal("18.00"), Decimal("3.00"))]
    assert _rows(S.levels(spark, ckpt).select("product_id", "stock", "buy_cents")) == [(1, 3, 250), (2, 3, None)]


def test_balances_start_from_a_snapshot(spark):
    src, led, ckpt = _folders(spark, scratch_path(spark, "stateful-opening"))
    customers = spark.createDataFrame([(1, 1, "Amal", None), (1, 2, "Basma", None)], CUSTOMERS)
    opening = spark.createDataFrame([(1, 1, Decimal("10.00"))], "shop_id long, customer_id long, balance decimal(20,2)")
    rows = [("payment", 1, 1, 1, Decimal("10.000"), None), ("payment", 1, 2, 2, Decimal("0.010"), None), ("gift", 1, 3, 2, Decimal("1.000"), None)]
    spark.createDataFrame(rows, I.CREDIT_COMMANDS).write.parquet(f"{src}/a")
    S.start_balance_stream(spark, src, customers, opening, led, ckpt, available_now=True).awaitTermination(300)
    got = {r.id: (r.status, r.reason) for r in spark.read.parquet(f"{led}/outcomes/credit").collect()}
    assert got == {1: ("accepted", ""), 2: ("rejected", "exceeds_balance"), 3: ("rejected", "unknown_type")}
