"""Dashboard and report operators, computed for all shops in one plan.

Every report is keyed by ``shop_id``; a single-shop call is the same plan with
a ``shop_id`` filter that Catalyst pushes into the scans.  Aggregations are
keyed on ``(shop_id, …)`` so partial (map-side) aggregation absorbs a hot shop
or product before the shuffle.  Money stays ``decimal`` until the final
projection; no Python UDFs.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import (
    LOW_AND_SOON,
    LOW_ONLY,
    SOON_DAYS,
    SOON_ONLY,
    WINDOW_DAYS,
    date_lit,
    dec,
    money_text,
    py_round1,
    safe_iso_date,
    to_double,
)

def for_shop(df: DataFrame, shop_id: int | None) -> DataFrame:
    """Tenant filter (P1); ``None`` keeps every shop."""
    return df if shop_id is None else df.where(F.col("shop_id") == F.lit(shop_id))


def dated_sales(sales: DataFrame) -> DataFrame:
    """Sales with a usable date (rows without one are left out of every report)."""
    return sales.where(F.col("sale_date").isNotNull())


def parse_sale_dates(sales_text: DataFrame) -> DataFrame:
    """P5: ISO text → date, unparsable rows dropped (never an ANSI error)."""
    return sales_text.withColumn("sale_date", safe_iso_date("sale_date")).where(F.col("sale_date").isNotNull())


def week_start(today: date) -> date:
    return today - timedelta(days=today.weekday())


def rank_within_shop(df: DataFrame, order: list[Column], limit: int | None, name: str = "rank") -> DataFrame:
    """Top-``limit`` rows per shop.

    ``row_number() <= k`` is planned as a WindowGroupLimit on both sides of the
    shuffle, so a shop with millions of rows sends only k rows per map task.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy("shop_id").orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col(name) <= limit)


# ---------------------------------------------------------------- rankings


def product_summary(sales: DataFrame) -> DataFrame:
    """Units, revenue and profit per (shop, product name); null names dropped."""
    return (
        sales.where(F.col("product_name").isNotNull())
        .groupBy("shop_id", "product_name")
        .agg(
            F.sum("quantity").cast("long").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
            F.sum("profit").alias("profit"),
        )
    )


def _ranking(summary: DataFrame, first: str, limit: int) -> DataFrame:
    order = [F.col(first).desc(), F.col("revenue").desc(), F.col("product_name").asc()]
    return rank_within_shop(summary, order, limit).select(
        "shop_id",
        "rank",
        "product_name",
        "units_sold",
        to_double("revenue").alias("revenue"),
        to_double("profit").alias("profit"),
    )


def top_selling_products(sales: DataFrame, limit: int = 10) -> DataFrame:
    """A2: all-time ranking by units then revenue (ties: name ascending)."""
    return _ranking(product_summary(dated_sales(sales)), "units_sold", limit)


def week_sales(sales: DataFrame, today: date) -> DataFrame:
    """Sales from Monday of ``today``'s week through ``today``."""
    return dated_sales(sales).where(F.col("sale_date").between(date_lit(week_start(today)), date_lit(today)))


def weekly_totals(shops: DataFrame, sales: DataFrame, today: date) -> DataFrame:
    """A3: revenue, profit and count of the week so far; zeros for quiet shops."""
    totals = week_sales(sales, today).groupBy("shop_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("profit").alias("profit"), F.count(F.lit(1)).alias("sales_count")
    )
    base = shops.select(F.col("id").alias("shop_id"))
    return base.join(totals, "shop_id", "left").select(
        "shop_id",
        date_lit(week_start(today)).alias("week_start"),
        date_lit(today).alias("week_end"),
        to_double(F.coalesce("revenue", dec("0"))).alias("revenue"),
        to_double(F.coalesce("profit", dec("0"))).alias("profit"),
        F.coalesce("sales_count", F.lit(0)).cast("long").alias("sales_count"),
    )


def weekly_top_products(sales: DataFrame, today: date, limit: int = 5) -> DataFrame:
    """This week's best sellers by units then revenue."""
    return _ranking(product_summary(week_sales(sales, today)), "units_sold", limit)


def weekly_highest_profit(sales: DataFrame, today: date, limit: int = 5) -> DataFrame:
    """This week's most profitable products (profit, then revenue)."""
    return _ranking(product_summary(week_sales(sales, today)), "profit", limit)


# ---------------------------------------------------------------- dashboard


def dashboard_metrics(shops: DataFrame, products: DataFrame, sales: DataFrame, today: date) -> DataFrame:
    """A1: today's revenue/profit, stock value and low-stock count per shop."""
    today_totals = (
        dated_sales(sales)
        .where(F.col("sale_date") == date_lit(today))
        .groupBy("shop_id")
        .agg(F.sum("revenue").alias("today_revenue"), F.sum("profit").alias("today_profit"))
    )
    stock = products.groupBy("shop_id").agg(
        F.sum(F.col("buy_price") * F.col("stock_quantity")).alias("total_stock_value"),
        F.count_if(F.col("stock_quantity") <= F.col("low_stock_threshold")).alias("low_stock_count"),
    )
    base = shops.select(F.col("id").alias("shop_id"))
    return (
        base.join(today_totals, "shop_id", "left")
        .join(stock, "shop_id", "left")
        .select(
            "shop_id",
            to_double(F.coalesce("today_revenue", dec("0"))).alias("today_revenue"),
            to_double(F.coalesce("today_profit", dec("0"))).alias("today_profit"),
            to_double(F.coalesce("total_stock_value", dec("0"))).alias("total_stock_value"),
            F.coalesce("low_stock_count", F.lit(0)).cast("long").alias("low_stock_count"),
        )
    )


PRODUCT_COLUMNS = [
    "shop_id",
    "id",
    "name",
    "category",
    "buy_price",
    "sell_price",
    "stock_quantity",
    "low_stock_threshold",
]


def product_list(products: DataFrame) -> DataFrame:
    """S1 projection with prices as doubles."""
    return products.select(
        *[to_double(c).alias(c) if c.endswith("_price") else F.col(c) for c in PRODUCT_COLUMNS]
    )


def low_stock_products(products: DataFrame) -> DataFrame:
    """Stock at or below the threshold (sort: stock, name)."""
    return product_list(products.where(F.col("stock_quantity") <= F.col("low_stock_threshold")))


def low_stock_view(products: DataFrame) -> DataFrame:
    """The dashboard's six-column low-stock table."""
    return low_stock_products(products).select(
        "shop_id", "id", "name", "category", "stock_quantity", "low_stock_threshold", "buy_price", "sell_price"
    )


# ---------------------------------------------------------------- restocking


def units_sold_7d(sales: DataFrame, today: date) -> DataFrame:
    """A4: units per product over ``today-6 .. today``; sales of deleted products dropped."""
    start = today - timedelta(days=WINDOW_DAYS - 1)
    return (
        dated_sales(sales)
        .where(F.col("sale_date").between(date_lit(start), date_lit(today)) & F.col("product_id").isNotNull())
        .groupBy("shop_id", "product_id")
        .agg(F.sum("quantity").cast("long").alias("units_sold_7d"))
    )


def restock_recommendations(products: DataFrame, sales: DataFrame, today: date) -> DataFrame:
    """Products at/below threshold or running out within 3 days.

    The 7-day totals are aggregated before the join (one row per product), so
    the join input is bounded by the product table, not by the sales ledger.
    """
    recent = units_sold_7d(sales, today).select(
        F.col("shop_id").alias("r_shop_id"), F.col("product_id").alias("r_product_id"), "units_sold_7d"
    )
    p = products.alias("p")
    joined = p.join(
        recent,
        (F.col("p.shop_id") == F.col("r_shop_id")) & (F.col("p.id") == F.col("r_product_id")),
        "left",
    )
    units = F.coalesce(F.col("units_sold_7d"), F.lit(0)).cast("int")
    avg = units.cast("double") / F.lit(float(WINDOW_DAYS))
    days = F.when(avg > 0, F.col("stock_quantity").cast("double") / avg)
    low = F.col("stock_quantity") <= F.col("low_stock_threshold")
    soon = F.coalesce(F.col("days_raw") < SOON_DAYS, F.lit(False))
    return (
        joined.select(
            F.col("p.shop_id").alias("shop_id"),
            F.col("p.id").alias("product_id"),
            "name",
            "category",
            "stock_quantity",
            "low_stock_threshold",
            units.alias("units_sold_7d"),
            avg.alias("avg_raw"),
            days.alias("days_raw"),
        )
        .where(low | soon)
        .select(
            "shop_id",
            "product_id",
            "name",
            "category",
            "stock_quantity",
            "low_stock_threshold",
            "units_sold_7d",
            F.round("avg_raw", 2).alias("average_daily_sales"),
            py_round1("days_raw").alias("estimated_days_until_stockout"),
            F.when(low & soon, F.lit(LOW_AND_SOON))
            .when(low, F.lit(LOW_ONLY))
            .otherwise(F.lit(SOON_ONLY))
            .alias("recommendation_reason"),
        )
    )


def recommendation_order() -> list[Column]:
    return [
        F.col("estimated_days_until_stockout").asc_nulls_last(),
        F.col("stock_quantity").asc(),
        F.col("name").asc(),
    ]


# ---------------------------------------------------------------- customers


def balance_totals(customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Per-customer debt, paid and remaining (decimals); zeros for customers
    without rows.  The ledger is pre-aggregated per customer before the join."""
    totals = debts.groupBy(F.col("shop_id").alias("t_shop_id"), F.col("customer_id").alias("t_customer_id")).agg(
        F.sum(F.when(F.col("transaction_type") == "debt", F.col("amount")).otherwise(dec("0"))).alias("d"),
        F.sum(F.when(F.col("transaction_type") == "payment", F.col("amount")).otherwise(dec("0"))).alias("p"),
    )
    joined = customers.join(
        totals, (F.col("shop_id") == F.col("t_shop_id")) & (F.col("id") == F.col("t_customer_id")), "left"
    )
    debt = F.coalesce("d", dec("0"))
    paid = F.coalesce("p", dec("0"))
    return joined.select(
        "shop_id",
        F.col("id").alias("customer_id"),
        F.col("name").alias("customer_name"),
        F.coalesce("phone", F.lit("")).alias("phone"),
        debt.alias("total_debt"),
        paid.alias("total_paid"),
        (debt - paid).alias("remaining_balance"),
    )


def customer_balances(customers: DataFrame, debts: DataFrame) -> DataFrame:
    """A5 (sort: remaining desc, then name)."""
    b = balance_totals(customers, debts)
    return b.select(
        "shop_id",
        "customer_id",
        "customer_name",
        "phone",
        *[to_double(c).alias(c) for c in ("total_debt", "total_paid", "remaining_balance")],
    )


def balance_order() -> list[Column]:
    return [
        F.col("remaining_balance").desc(),
        F.lower(F.col("customer_name")).asc(),
        F.col("customer_name").asc(),
    ]


def debt_pivot(debts: DataFrame) -> DataFrame:
    """Debt and payment sums as columns; a missing type reads 0."""
    return (
        debts.groupBy("shop_id", "customer_id")
        .pivot("transaction_type", ["debt", "payment"])
        .agg(F.sum("amount"))
        .select(
            "shop_id",
            "customer_id",
            to_double(F.coalesce("debt", dec("0"))).alias("debt"),
            to_double(F.coalesce("payment", dec("0"))).alias("payment"),
        )
    )


def total_unpaid_debt(shops: DataFrame, customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Σ max(balance, 0) per shop (P22 clip), 0 for shops without customers."""
    per_shop = (
        balance_totals(customers, debts)
        .groupBy("shop_id")
        .agg(F.sum(F.greatest(F.col("remaining_balance"), dec("0"))).alias("total_unpaid"))
    )
    base = shops.select(F.col("id").alias("shop_id"))
    return base.join(per_shop, "shop_id", "left").select(
        "shop_id", to_double(F.coalesce("total_unpaid", dec("0"))).alias("total_unpaid")
    )


def customer_balance_lookup(customers: DataFrame, debts: DataFrame, requests: DataFrame) -> DataFrame:
    """Balances of the requested ``(shop_id, customer_id)`` pairs only.

    The request list is semi-joined into both inputs before aggregating, so
    only the requested customers' ledger rows are summed.
    """
    keys = requests.select("shop_id", "customer_id").distinct()
    c = customers.join(
        keys.select("shop_id", F.col("customer_id").alias("id")), ["shop_id", "id"], "left_semi"
    )
    d = debts.join(keys, ["shop_id", "customer_id"], "left_semi")
    return customer_balances(c, d)


def unpaid_customers(customers: DataFrame, debts: DataFrame) -> DataFrame:
    """P10: customers whose remaining balance is above zero."""
    return customer_balances(customers, debts).where(F.col("remaining_balance") > 0)


def balance_labels(customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Remaining balance as money text."""
    return balance_totals(customers, debts).select(
        "shop_id", "customer_id", "customer_name", money_text("remaining_balance").alias("balance_label")
    )


# ---------------------------------------------------------------- row views


def sale_amounts(products: DataFrame, requests: DataFrame) -> DataFrame:
    """revenue = sell·qty, profit = (sell−buy)·qty at the product's price."""
    p = products.select(
        F.col("shop_id").alias("p_shop_id"), F.col("id").alias("p_id"), "buy_price", "sell_price"
    )
    j = requests.join(p, (F.col("shop_id") == F.col("p_shop_id")) & (F.col("product_id") == F.col("p_id")), "inner")
    return j.select(
        "shop_id",
        "id",
        "product_id",
        "quantity",
        to_double(F.col("sell_price") * F.col("quantity")).alias("revenue"),
        to_double((F.col("sell_price") - F.col("buy_price")) * F.col("quantity")).alias("profit"),
    )


def restock_export(restocks: DataFrame) -> DataFrame:
    """The price-update flag as Yes/No (anything else → null)."""
    flag = F.col("updated_buy_price")
    return restocks.select(
        "shop_id",
        "id",
        "product_name",
        "quantity_added",
        "supplier_name",
        to_double("unit_buy_price").alias("unit_buy_price"),
        F.date_format("restock_date", "yyyy-MM-dd").alias("restock_date"),
        F.when(flag, F.lit("Yes")).when(~flag, F.lit("No")).alias("updated_buy_price"),
    )


def coerce_products(rows: DataFrame) -> DataFrame:
    """Numeric text to numbers; unparsable or empty → 0."""
    from ..functions.expr import coerce_int, coerce_money

    return rows.select(
        "shop_id",
        "seq",
        "name",
        to_double(coerce_money("buy_price")).alias("buy_price"),
        to_double(coerce_money("sell_price")).alias("sell_price"),
        coerce_int("stock_quantity").alias("stock_quantity"),
        coerce_int("low_stock_threshold").alias("low_stock_threshold"),
    )


def clean_customer_input(requests: DataFrame) -> DataFrame:
    """Trimmed names and phones, blank → null."""
    from ..functions.expr import blank_to_null

    return requests.select(
        "shop_id",
        "seq",
        blank_to_null("customer_name").alias("customer_name"),
        blank_to_null("phone").alias("phone"),
    )
