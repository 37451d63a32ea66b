"""The reference's data tests, as batch operators over small frames."""

from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from conftest import LEDGER_CMD, RESTOCK_CMD, SALE_CMD, d, products_df

from tallyspark import schemas as S
from tallyspark.operators import ledger as L
from tallyspark.operators import reports as R

DAY = date(2026, 6, 12)


@pytest.mark.parametrize(
    "row, reason",
    [
        (("", "Food", 1.0, 2.0, 1, 1), "name_required"),
        (("Rice", " ", 1.0, 2.0, 1, 1), "category_required"),
        (("Rice", "Food", -1.0, 2.0, 1, 1), "negative_price"),
        (("Rice", "Food", 1.0, -1.0, 1, 1), "negative_price"),
        (("Rice", "Food", 1.0, 2.0, -1, 1), "negative_stock"),
        (("Rice", "Food", 1.0, 2.0, 1, -1), "negative_stock"),
    ],
)
def test_bad_product_rejected(spark, row, reason):
    name, cat, buy, sell, stock, thr = row
    req = spark.createDataFrame(
        [(1, 1, name, cat, d(buy), d(sell), stock, thr)],
        "shop_id long, seq long, name string, category string, buy_price decimal(12,2), "
        "sell_price decimal(12,2), stock_quantity int, low_stock_threshold int",
    )
    out = L.validate_products(req).collect()[0]
    assert not out.accepted
    assert reason in out.reasons.split(";")
    empty = spark.createDataFrame([], S.PRODUCTS)
    assert L.insert_products(empty, req).count() == 0


def test_oversell_rejected(spark):
    p = products_df(spark, [(1, 1, "Milk", "Dairy", 1.0, 2.0, 2, 1)])
    cmd = spark.createDataFrame([(1, 1, "s1", DAY, 3)], SALE_CMD)
    out = L.apply_sales(p, cmd).collect()
    assert [r.status for r in out] == ["rejected"]
    assert out[0].reason == "insufficient_stock"
    assert L.apply_sales_stock(p, cmd).collect()[0].stock_quantity == 2


def test_overpayment_rejected(spark):
    customers = spark.createDataFrame([(1, 7, "Amina", None)], S.CUSTOMERS)
    led = spark.createDataFrame(
        [(1, 1, 7, "debt", d(100), DAY), (1, 2, 7, "payment", d(101), DAY)], LEDGER_CMD
    )
    out = {r.id: r for r in L.apply_payments(customers, led).collect()}
    assert out[1].status == "accepted"
    assert out[2].status == "rejected" and out[2].reason == "exceeds_balance"
    accepted = led.join(
        L.apply_payments(customers, led).where("status = 'accepted'").select("id"), "id", "left_semi"
    )
    bal = R.customer_balances(customers, accepted).collect()[0]
    assert bal.total_paid == 0.0 and bal.remaining_balance == 100.0


def test_restock_updates_stock_and_price(spark):
    p = products_df(spark, [(1, 1, "Oil", "Food", 20.0, 30.0, 4, 2)])
    cmd = spark.createDataFrame([(1, 1, "r1", DAY, 8, "Supplier A", d(21.5), True)], RESTOCK_CMD)
    after = L.apply_restocks_stock(p, cmd).collect()[0]
    assert after.stock_quantity == 12
    assert after.buy_price == Decimal("21.50")
    assert L.apply_restocks(p, cmd).count() == 1


def test_sale_amounts_and_stock(spark):
    p = products_df(spark, [(1, 1, "Tea", "Drinks", 1.2, 2.0, 20, 5)])
    cmd = spark.createDataFrame([(1, 1, "s1", DAY, 5)], SALE_CMD)
    sale = L.apply_sales(p, cmd).collect()[0]
    assert (sale.status, sale.revenue, sale.profit) == ("accepted", 10.0, 4.0)
    assert L.apply_sales_stock(p, cmd).collect()[0].stock_quantity == 15
