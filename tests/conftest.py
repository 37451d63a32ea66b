"""Shared fixtures: one local session for the whole run, small frame helpers."""

from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from tallyspark import schemas as S  # noqa: E402
from tallyspark.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
TODAY = date(1998, 6, 12)


@pytest.fixture(scope="session")
def spark():
    s = build_session(master="local[4]", app_name="tallyspark-tests", shuffle_partitions=4)
    yield s
    s.stop()


def d(x) -> Decimal:
    return Decimal(str(x)).quantize(Decimal("0.01"))


def products_df(spark, rows):
    """rows: (shop_id, id, name, category, buy, sell, stock, threshold)."""
    return spark.createDataFrame(
        [(s, i, n, c, d(b), d(p), q, t) for s, i, n, c, b, p, q, t in rows], S.PRODUCTS
    )


SALE_CMD = "shop_id long, product_id long, id string, command_date date, quantity int"
RESTOCK_CMD = (
    "shop_id long, product_id long, id string, command_date date, quantity int, supplier_name string, "
    "unit_buy_price decimal(12,2), update_buy_price boolean"
)
LEDGER_CMD = (
    "shop_id long, id long, customer_id long, transaction_type string, amount decimal(12,2), transaction_date date"
)
