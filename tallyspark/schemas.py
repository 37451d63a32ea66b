"""Declared schemas of the ledger tables (never inferred).

Money is ``decimal(12,2)`` everywhere inside plans; reports cast to double
only in their final projection.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(12, 2)


def _s(*fields: tuple[str, object, bool]) -> StructType:
    return StructType([StructField(n, t, nullable) for n, t, nullable in fields])


SHOPS = _s(("id", LongType(), False), ("name", StringType(), True), ("owner_id", LongType(), True))

PROFILES = _s(
    ("id", LongType(), False),
    ("shop_id", LongType(), True),
    ("full_name", StringType(), True),
    ("role", StringType(), True),
)

PRODUCTS = _s(
    ("shop_id", LongType(), False),
    ("id", LongType(), False),
    ("name", StringType(), True),
    ("category", StringType(), True),
    ("buy_price", MONEY, True),
    ("sell_price", MONEY, True),
    ("stock_quantity", IntegerType(), True),
    ("low_stock_threshold", IntegerType(), True),
)

SALES = _s(
    ("shop_id", LongType(), False),
    ("id", StringType(), False),
    ("product_id", LongType(), True),
    ("product_name", StringType(), True),
    ("quantity", IntegerType(), True),
    ("sale_date", DateType(), True),
    ("revenue", MONEY, True),
    ("profit", MONEY, True),
)

CUSTOMERS = _s(
    ("shop_id", LongType(), False),
    ("id", LongType(), False),
    ("name", StringType(), True),
    ("phone", StringType(), True),
)

DEBTS = _s(
    ("shop_id", LongType(), False),
    ("id", LongType(), False),
    ("customer_id", LongType(), False),
    ("customer_name", StringType(), True),
    ("transaction_type", StringType(), True),
    ("amount", MONEY, True),
    ("note", StringType(), True),
    ("transaction_date", DateType(), True),
)

RESTOCKS = _s(
    ("shop_id", LongType(), False),
    ("id", StringType(), False),
    ("product_id", LongType(), True),
    ("product_name", StringType(), True),
    ("quantity_added", IntegerType(), True),
    ("supplier_name", StringType(), True),
    ("unit_buy_price", MONEY, True),
    ("restock_date", DateType(), True),
    ("updated_buy_price", BooleanType(), True),
)

QUESTIONS = _s(
    ("question_id", LongType(), False),
    ("shop_id", LongType(), False),
    ("question", StringType(), True),
)

# Driver tables: the columns we read, with the types found in the files.
DRIVER = {
    "region": _s(("r_regionkey", IntegerType(), True), ("r_name", StringType(), True)),
    "nation": _s(
        ("n_nationkey", IntegerType(), True),
        ("n_name", StringType(), True),
        ("n_regionkey", IntegerType(), True),
    ),
    "customer": _s(
        ("c_custkey", LongType(), True),
        ("c_name", StringType(), True),
        ("c_nationkey", IntegerType(), True),
        ("c_acctbal", DoubleType(), True),
        ("c_mktsegment", StringType(), True),
    ),
    "supplier": _s(
        ("s_suppkey", LongType(), True),
        ("s_name", StringType(), True),
        ("s_nationkey", IntegerType(), True),
        ("s_acctbal", DoubleType(), True),
    ),
    "part": _s(
        ("p_partkey", LongType(), True),
        ("p_name", StringType(), True),
        ("p_brand", StringType(), True),
        ("p_type", StringType(), True),
        ("p_size", IntegerType(), True),
        ("p_retailprice", DoubleType(), True),
    ),
    "orders": _s(
        ("o_orderkey", LongType(), True),
        ("o_custkey", LongType(), True),
        ("o_orderstatus", StringType(), True),
        ("o_totalprice", DoubleType(), True),
        ("o_orderdate", TimestampNTZType(), True),
        ("o_orderpriority", StringType(), True),
    ),
    "lineitem": _s(
        ("l_orderkey", LongType(), True),
        ("l_partkey", LongType(), True),
        ("l_suppkey", LongType(), True),
        ("l_linenumber", IntegerType(), True),
        ("l_quantity", DoubleType(), True),
        ("l_extendedprice", DoubleType(), True),
        ("l_discount", DoubleType(), True),
        ("l_tax", DoubleType(), True),
        ("l_returnflag", StringType(), True),
        ("l_linestatus", StringType(), True),
        ("l_shipdate", TimestampNTZType(), True),
    ),
    "conversations": _s(
        ("conv_id", LongType(), True),
        ("turn", LongType(), True),
        ("role", StringType(), True),
        ("text", StringType(), True),
    ),
}
