"""Demo-data generators (G1, G2) as distributed jobs.

G1 draws a daily quantity per product and day from the product's range.  The
draw is an arithmetic hash of ``(shop, product, day)`` instead of a
sequential random generator, so every row is computed independently, in any
partition, and re-running a lost task gives the same rows.  Days come from
``explode(sequence(..))`` per product row (a generator, not a join).

G2 turns rows written with names and "days ago" into ledger rows: names are
resolved to ids by an equi-join on ``(shop_id, name)``, dates are made
relative to ``today``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import date_lit, to_double

# Fixed values of the generator: history length, weekend boost, hash constants.
HISTORY_DAYS = 14
WEEKEND_BOOST = 1.15
HASH_PRODUCT = 7919
HASH_DAY = 104729
HASH_SHOP = 15485863
HASH_MODULUS = 2147483647


def daily_draw(shop_id: Column, product_id: Column, day_no: Column, low: Column, high: Column) -> Column:
    """Deterministic integer in ``[low, high]`` for one product and day."""
    h = F.pmod(product_id * HASH_PRODUCT + day_no * HASH_DAY + shop_id * HASH_SHOP, F.lit(HASH_MODULUS))
    return low + F.pmod(h, high - low + F.lit(1))


def generate_sales(products: DataFrame, ranges: DataFrame, today: date, days: int = HISTORY_DAYS) -> DataFrame:
    """G1: one sale per product and day over ``today-days+1 .. today``.

    ``ranges(shop_id, product_id, min_units, max_units)`` holds each product's
    daily range.  Weekend quantities are ×1.15 rounded half-even on the
    double value (as Python's ``round``); quantities ≤ 0 are skipped; revenue
    and profit are exact decimals at the product's prices.
    """
    p = products.join(
        ranges.select("shop_id", F.col("product_id").alias("id"), "min_units", "max_units"), ["shop_id", "id"], "inner"
    )
    per_day = p.select(
        "shop_id", "id", "name", "buy_price", "sell_price", "min_units", "max_units",
        F.explode(F.sequence(F.lit(days - 1), F.lit(0), F.lit(-1))).alias("days_ago"),
    ).withColumn("sale_date", F.date_sub(date_lit(today), F.col("days_ago")))
    raw = daily_draw(F.col("shop_id"), F.col("id"), F.col("days_ago"), F.col("min_units"), F.col("max_units"))
    weekend = F.dayofweek("sale_date").isin(1, 7)
    qty = F.when(weekend, F.bround(raw.cast("double") * F.lit(WEEKEND_BOOST), 0)).otherwise(raw).cast("int")
    drawn = per_day.withColumn("quantity", qty).where(F.col("quantity") > 0)
    return drawn.select(
        "shop_id",
        F.concat_ws("-", F.col("id").cast("string"), F.date_format("sale_date", "yyyyMMdd")).alias("id"),
        F.col("id").alias("product_id"),
        F.col("name").alias("product_name"),
        "quantity",
        "sale_date",
        to_double(F.col("sell_price") * F.col("quantity")).alias("revenue"),
        to_double((F.col("sell_price") - F.col("buy_price")) * F.col("quantity")).alias("profit"),
    )


def resolve_relative_rows(
    rows: DataFrame,
    names: DataFrame,
    today: date,
    *,
    name_col: str,
    id_col: str,
    date_col: str,
) -> DataFrame:
    """``rows`` (with ``shop_id``, ``name_col``, ``days_ago``) → rows with the
    named entity's id in ``id_col`` and ``date_col = today - days_ago``.

    ``names(shop_id, id, name)`` is the current table; names match exactly, as
    the generator wrote them; a row whose name is absent is dropped.  Should a
    name occur twice, the highest id wins (a name → id map built in id order),
    and the lookup side has one row per name, so no row is duplicated.
    """
    keys = names.groupBy("shop_id", F.col("name").alias(name_col)).agg(F.max("id").alias(id_col))
    j = rows.join(keys, ["shop_id", name_col], "inner")
    return j.withColumn(date_col, F.date_sub(date_lit(today), F.col("days_ago"))).drop("days_ago")
