"""Ledger tables derived from the driver's TPC-H-like tables.

Every function returns a lazy DataFrame over the *whole* driver table(s);
the SQL twins used by the DuckDB oracle live in ``plans/oracle.py`` and must
stay formula-for-formula identical to these.


* shops      <- nation      id=n_nationkey, owner_id=n_regionkey
* profiles   <- nation      one owner per region, shop = lowest nation key
* products   <- part        shop_id = p_partkey % 25
* sales      <- lineitem ⨝ part
* customers  <- customer    shop_id = c_nationkey
* debts      <- orders ⨝ customer (F,P → debt, O → payment)
* restocks   <- lineitem (returnflag R) ⨝ supplier ⨝ part
* commands   <- the same ledgers replayed as batches for the M* operators

Dirty values for the validation operators are injected by fixed rules on
the keys; every row of the source is still emitted.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import dec, money
from ..schemas import MONEY
from .driver import DriverTables

# Fixed values of the fixture mapping.
TODAY = date(1998, 6, 12)
SHOP_COUNT = 25
BUY_RATIO = "0.80"
PROFIT_RATIO = "0.20"
RESTOCK_PRICE_RATIO = "0.05"
DISCONTINUED_BRAND = "Brand#13"


def _line_id(li: str = "") -> F.Column:
    """Unique text id of a lineitem row (order/line pairs repeat in the data)."""
    c = lambda n: F.col(f"{li}{n}")
    return F.concat_ws(
        "-",
        c("l_orderkey").cast("string"),
        c("l_linenumber").cast("string"),
        c("l_partkey").cast("string"),
        c("l_suppkey").cast("string"),
        F.date_format(c("l_shipdate"), "yyyyMMdd"),
        c("l_quantity").cast("int").cast("string"),
        (money(c("l_extendedprice")) * 100).cast("bigint").cast("string"),
    )


def _product_name(partkey: str = "p_partkey", name: str = "p_name") -> F.Column:
    return F.concat(F.col(name), F.lit(" "), F.col(partkey).cast("string"))


def shops(t: DriverTables) -> DataFrame:
    return t.nation.select(
        F.col("n_nationkey").cast("long").alias("id"),
        F.col("n_name").alias("name"),
        F.col("n_regionkey").cast("long").alias("owner_id"),
    )


def profiles(t: DriverTables) -> DataFrame:
    firsts = t.nation.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("shop_id"))
    return firsts.join(t.region, firsts.n_regionkey == t.region.r_regionkey, "left").select(
        F.col("n_regionkey").cast("long").alias("id"),
        F.col("shop_id").cast("long").alias("shop_id"),
        F.col("r_name").alias("full_name"),
        F.lit("owner").alias("role"),
    )


def products(t: DriverTables) -> DataFrame:
    sell = money("p_retailprice")
    return t.part.select(
        (F.col("p_partkey") % SHOP_COUNT).alias("shop_id"),
        F.col("p_partkey").alias("id"),
        _product_name().alias("name"),
        F.col("p_type").alias("category"),
        money(sell * dec(BUY_RATIO)).alias("buy_price"),
        sell.alias("sell_price"),
        ((F.col("p_partkey") * 37 + F.col("p_size")) % 120).cast("int").alias("stock_quantity"),
        F.col("p_size").alias("low_stock_threshold"),
    )


def sales(t: DriverTables) -> DataFrame:
    li, p = t.lineitem, t.part.select("p_partkey", "p_name")
    revenue = money(money("l_extendedprice") * (dec("1") - money("l_discount")))
    return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        (F.col("l_partkey") % SHOP_COUNT).alias("shop_id"),
        _line_id().alias("id"),
        F.col("l_partkey").alias("product_id"),
        _product_name().alias("product_name"),
        F.col("l_quantity").cast("int").alias("quantity"),
        F.col("l_shipdate").cast("date").alias("sale_date"),
        revenue.alias("revenue"),
        money(revenue * dec(PROFIT_RATIO)).alias("profit"),
    )


def sales_text_dates(t: DriverTables) -> DataFrame:
    """Sales whose date arrives as text, some of it unparsable (for P5)."""
    iso = F.date_format(F.col("sale_date"), "yyyy-MM-dd")
    key = F.split(F.col("id"), "-").getItem(0).cast("long")
    text = (
        F.when(key % 23 == 0, F.lit("bad"))
        .when(key % 29 == 0, F.date_format(F.col("sale_date"), "MM/dd/yyyy"))
        .otherwise(iso)
    )
    return sales(t).withColumn("sale_date", text)


def customers(t: DriverTables) -> DataFrame:
    phone = F.when(F.col("c_custkey") % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("06"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))
    )
    return t.customer.select(
        F.col("c_nationkey").cast("long").alias("shop_id"),
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        phone.alias("phone"),
    )


def debts(t: DriverTables) -> DataFrame:
    o, c = t.orders, t.customer.select("c_custkey", "c_name", "c_nationkey")
    kind = F.when(F.col("o_orderstatus").isin("F", "P"), F.lit("debt")).otherwise(F.lit("payment"))
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("c_nationkey").cast("long").alias("shop_id"),
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        kind.alias("transaction_type"),
        money("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("note"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
    )


def restocks(t: DriverTables) -> DataFrame:
    li = t.lineitem
    s = t.supplier.select("s_suppkey", "s_name")
    p = t.part.select("p_partkey", "p_name")
    return (
        li.join(s, li.l_suppkey == s.s_suppkey, "inner")
        .join(p, li.l_partkey == p.p_partkey, "inner")
        .select(
            (F.col("l_partkey") % SHOP_COUNT).alias("shop_id"),
            _line_id().alias("id"),
            F.col("l_partkey").alias("product_id"),
            _product_name().alias("product_name"),
            F.col("l_quantity").cast("int").alias("quantity_added"),
            F.col("s_name").alias("supplier_name"),
            money(money("l_extendedprice") * dec(RESTOCK_PRICE_RATIO)).alias("unit_buy_price"),
            F.col("l_shipdate").cast("date").alias("restock_date"),
            (F.col("l_linestatus") == "O").alias("updated_buy_price"),
        )
    )


def discontinued_products(t: DriverTables) -> DataFrame:
    """Delete batch for M3: every product of one brand, plus ids that do not exist."""
    gone = t.part.where(F.col("p_brand") == DISCONTINUED_BRAND).select(
        (F.col("p_partkey") % SHOP_COUNT).alias("shop_id"), F.col("p_partkey").alias("id")
    )
    missing = t.part.where(F.col("p_brand") == DISCONTINUED_BRAND).select(
        (F.col("p_partkey") % SHOP_COUNT).alias("shop_id"),
        (F.col("p_partkey") + 1_000_000_000).alias("id"),
    )
    return gone.unionByName(missing)


def product_requests(t: DriverTables) -> DataFrame:
    """Insert batch for V1/V2/M1 with blank, negative and duplicate values."""
    k = F.col("p_partkey")
    sell = money("p_retailprice")
    name = (
        F.when(k % 34 == 0, F.lit("\t\u00a0"))
        .when(k % 17 == 0, F.lit("  "))
        .when(k % 11 == 0, F.upper(_product_name()))
        .when(k % 13 == 0, F.concat(F.col("p_brand"), F.lit(" special")))
        .otherwise(F.concat(F.lit(" "), F.col("p_name"), F.lit(" new "), k.cast("string")))
    )
    return t.part.select(
        (k % SHOP_COUNT).alias("shop_id"),
        k.alias("seq"),
        name.alias("name"),
        F.when(k % 23 == 0, F.lit("")).otherwise(F.col("p_type")).alias("category"),
        F.when(k % 19 == 0, dec("-1.00")).when(k % 41 != 0, money(sell * dec(BUY_RATIO))).cast(MONEY).alias("buy_price"),
        F.when(k % 29 == 0, dec("-1.00")).otherwise(sell).cast(MONEY).alias("sell_price"),
        F.when(k % 31 == 0, F.lit(-1)).when(k % 43 != 0, F.col("p_size")).cast("int").alias("stock_quantity"),
        F.when(k % 37 == 0, F.lit(-1)).otherwise(F.lit(5)).cast("int").alias("low_stock_threshold"),
    )


def product_updates(t: DriverTables) -> DataFrame:
    """Full-row update commands for M2: several per product, some unknown ids and null
    prices; renames to names that several products want, lose and take again."""
    li = t.lineitem
    p = t.part.select("p_partkey", "p_name", "p_type")
    ext = money("l_extendedprice")
    k = F.col("l_orderkey")
    name = (
        F.when(k % 10 == 3, F.concat(F.lit("Shared "), (F.col("l_partkey") % 5).cast("string")))
        .when(k % 10 == 4, F.upper(_product_name()))
        .when(k % 10 == 5, F.concat(F.lit("\tpool "), (k % 7).cast("string")))
        .otherwise(_product_name())
    )
    pid = F.when(F.col("l_orderkey") % 9 == 0, F.col("l_partkey") + 1_000_000_000).otherwise(F.col("l_partkey"))
    return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        (F.col("l_partkey") % SHOP_COUNT).alias("shop_id"),
        pid.alias("id"),
        F.col("l_shipdate").cast("date").alias("command_date"),
        _line_id().alias("command_id"),
        name.alias("name"),
        F.col("p_type").alias("category"),
        F.when(k % 13 != 0, money(ext * dec("0.015"))).alias("buy_price"),
        money(ext * dec("0.02")).alias("sell_price"),
        F.col("l_quantity").cast("int").alias("stock_quantity"),
        F.col("l_linenumber").alias("low_stock_threshold"),
    )


def sale_commands(t: DriverTables) -> DataFrame:
    """Every lineitem replayed as a sale request against the product snapshot."""
    return t.lineitem.select(
        (F.col("l_partkey") % SHOP_COUNT).alias("shop_id"),
        F.col("l_partkey").alias("product_id"),
        _line_id().alias("id"),
        F.col("l_shipdate").cast("date").alias("command_date"),
        F.col("l_quantity").cast("int").alias("quantity"),
    )


def restock_commands(t: DriverTables) -> DataFrame:
    """Restock requests (every lineitem; a tenth of the units unless returned), some with
    blank supplier, null price or bad values."""
    li = t.lineitem
    units = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(F.floor(F.col("l_quantity") / 10))
    s = t.supplier.select("s_suppkey", "s_name")
    k = F.col("l_orderkey")
    return li.join(s, li.l_suppkey == s.s_suppkey, "inner").select(
        (F.col("l_partkey") % SHOP_COUNT).alias("shop_id"),
        F.col("l_partkey").alias("product_id"),
        _line_id().alias("id"),
        F.col("l_shipdate").cast("date").alias("command_date"),
        F.when(k % 41 == 0, F.lit(0)).otherwise(units.cast("int")).alias("quantity"),
        F.when(k % 43 == 0, F.lit(" \n")).otherwise(F.col("s_name")).alias("supplier_name"),
        F.when(k % 53 != 0, money(money("l_extendedprice") * dec(RESTOCK_PRICE_RATIO))).alias("unit_buy_price"),
        (F.col("l_linestatus") == "O").alias("update_buy_price"),
    )


def debt_commands(t: DriverTables) -> DataFrame:
    """New-debt requests for M5: names typed in varying case, new walk-in names."""
    o, c = t.orders, t.customer.select("c_custkey", "c_name", "c_nationkey")
    k = F.col("o_orderkey")
    typed = (
        F.when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("Guest "), (F.col("o_custkey") % 7).cast("string")))
        .when(k % 3 == 0, F.lower(F.col("c_name")))
        .when(k % 3 == 1, F.upper(F.col("c_name")))
        .otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit(" ")))
    )
    phone = F.when(
        F.col("o_orderpriority") == "1-URGENT",
        F.concat(F.lit("07"), F.lpad((k % 100000000).cast("string"), 8, "0")),
    ).otherwise(F.lit(" "))
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("c_nationkey").cast("long").alias("shop_id"),
        k.alias("seq"),
        typed.alias("customer_name"),
        phone.alias("phone"),
        F.when(k % 47 == 0, dec("0.004")).otherwise(F.col("o_totalprice")).cast("double").alias("amount"),
        F.col("o_orderpriority").alias("note"),
        F.col("o_orderdate").cast("date").alias("command_date"),
    )


def credit_commands(t: DriverTables) -> DataFrame:
    """The debt ledger as raw commands for M7: amounts with fractions of a cent, unknown and null types."""
    k = F.col("id")
    amount = F.col("amount") + F.when(k % 3 == 0, dec("0.004")).otherwise(dec("0.000"))
    return debts(t).select(
        "shop_id",
        "id",
        "customer_id",
        "customer_name",
        F.when(k % 59 == 0, F.lit("refund")).when(k % 61 != 0, F.col("transaction_type")).alias("transaction_type"),
        F.when(k % 67 == 0, dec("0.004")).otherwise(amount).cast("decimal(14,3)").alias("amount"),
        "note",
        "transaction_date",
    )


def shop_delete_requests(t: DriverTables) -> DataFrame:
    return shops(t).select(F.col("id").alias("shop_id"))


def profile_requests(t: DriverTables) -> DataFrame:
    """Profile inserts: the caller claims a shop; role or id differs or is null for some."""
    n = t.nation
    return n.select(
        F.col("n_nationkey").cast("long").alias("request_id"),
        F.col("n_regionkey").cast("long").alias("caller_id"),
        F.when(F.col("n_nationkey") % 4 == 3, (F.col("n_regionkey") + 1) % 5)
        .when(F.col("n_nationkey") % 11 != 10, F.col("n_regionkey"))
        .cast("long")
        .alias("id"),
        F.col("n_nationkey").cast("long").alias("shop_id"),
        F.when(F.col("n_nationkey") % 6 == 5, F.lit("staff"))
        .when(F.col("n_nationkey") % 7 != 6, F.lit("owner"))
        .alias("role"),
    )


def tenant_requests(t: DriverTables) -> DataFrame:
    """Every sale as a write attempt by the owner of its shop; some name no shop, some callers have no profile."""
    s = sales(t)
    sh = shops(t).select(F.col("id").alias("sid"), F.col("owner_id").alias("caller_id"))
    requested = F.when(~F.col("quantity").isin(13, 14), F.col("shop_id"))
    caller = F.when(F.col("quantity") % 4 == 1, F.col("caller_id") + 1_000_000).otherwise(F.col("caller_id"))
    return s.join(sh, s.shop_id == sh.sid, "inner").select(
        F.col("id").alias("request_id"), caller.alias("caller_id"), requested.alias("requested_shop_id")
    )


def onboarding_requests(t: DriverTables) -> DataFrame:
    """Shop sign-ups: every supplier asks for a shop; region owners ask again."""
    s = t.supplier.select(
        (F.col("s_suppkey") + 100).alias("user_id"),
        F.when(F.col("s_suppkey") % 9 == 0, F.lit("   ")).otherwise(F.concat(F.col("s_name"), F.lit(" shop"))).alias("shop_name"),
        F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("full_name"),
        (F.col("s_suppkey") + 100).alias("seq"),
    )
    r = t.region.select(
        F.col("r_regionkey").cast("long").alias("user_id"),
        F.concat(F.col("r_name"), F.lit(" second shop")).alias("shop_name"),
        F.col("r_name").alias("full_name"),
        F.col("r_regionkey").cast("long").alias("seq"),
    )
    return s.unionByName(r)


# Questions asked to the assistant (one set per shop).
QUESTION_PHRASES = [
    "What should I restock?",
    "Should I restock my best product?",
    "What are my best products?",
    "Best selling product please",
    "How much profit this week?",
    "Weekly profit?",
    "How much profit today?",
    "daily profit",
    "Who owes me money?",
    "who has debt",
    "What is my total unpaid debt?",
    "unpaid",
    "total debt",
    "Show low stock products",
    "LOW STOCK",
    "hello",
    "What is the weather?",
    "best",
    "profit",
    "   Who OWES me?   ",
]


def questions(t: DriverTables) -> DataFrame:
    """Fixed phrases for every shop, plus every turn of ``conversations``."""
    phrases = F.array(*[F.lit(q) for q in QUESTION_PHRASES])
    fixed = shops(t).select(F.col("id").alias("shop_id"), F.posexplode(phrases).alias("phrase_no", "question")).select(
        (F.col("shop_id") * 1000 + F.col("phrase_no")).alias("question_id"),
        "shop_id",
        "question",
    )
    conv = t.conversations.select(
        (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"),
        (F.col("conv_id") % SHOP_COUNT).alias("shop_id"),
        F.col("text").alias("question"),
    )
    return fixed.unionByName(conv)


def product_text_rows(t: DriverTables) -> DataFrame:
    """The insert batch as it arrives from a text source (P14): numbers as text, some junk."""
    r = product_requests(t)
    k = F.col("seq")
    return r.select(
        "shop_id",
        "seq",
        "name",
        F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.col("buy_price").cast("string")).alias("buy_price"),
        F.when(k % 5 == 0, F.lit("")).otherwise(F.col("sell_price").cast("string")).alias("sell_price"),
        F.when(k % 9 == 0, F.lit("12.7")).when(k % 9 == 3, F.lit("1e1")).when(k % 3 == 0, F.lit(" 12\t"))
        .otherwise(F.col("stock_quantity").cast("string")).alias("stock_quantity"),
        F.when(k % 8 == 0, F.lit("x")).otherwise(F.col("low_stock_threshold").cast("string")).alias("low_stock_threshold"),
    )


CLOSED_SEGMENT = "HOUSEHOLD"


def customer_deletes(t: DriverTables) -> DataFrame:
    """Customer delete batch for M3b: every customer of one market segment."""
    return t.customer.where(F.col("c_mktsegment") == CLOSED_SEGMENT).select(
        F.col("c_nationkey").cast("long").alias("shop_id"), F.col("c_custkey").alias("id")
    )


def product_daily_ranges(t: DriverTables) -> DataFrame:
    """G1 input: each product's daily unit range (min from the size, width from the key)."""
    low = F.col("p_size") % 4
    return t.part.select(
        (F.col("p_partkey") % SHOP_COUNT).alias("shop_id"),
        F.col("p_partkey").alias("product_id"),
        low.cast("int").alias("min_units"),
        (low + F.col("p_partkey") % 9).cast("int").alias("max_units"),
    )


DEMO_DAYS = 30


def demo_debt_rows(t: DriverTables) -> DataFrame:
    """G2 input: debt rows written by customer name with a "days ago" offset."""
    o, c = t.orders, t.customer.select("c_custkey", "c_name", "c_nationkey")
    kind = F.when(F.col("o_orderstatus").isin("F", "P"), F.lit("debt")).otherwise(F.lit("payment"))
    return o.join(c, o.o_custkey == c.c_custkey, "inner").select(
        F.col("c_nationkey").cast("long").alias("shop_id"),
        F.col("o_orderkey").alias("id"),
        F.col("c_name").alias("customer_name"),
        kind.alias("transaction_type"),
        money("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("note"),
        (F.col("o_orderkey") % DEMO_DAYS).cast("int").alias("days_ago"),
    )
