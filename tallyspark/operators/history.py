"""List views of the tables and ledgers.

Ledger histories are "newest first" (date DESC, id DESC).  Name resolution
for sales/restocks is a parameter: ``snapshot`` keeps the name written with
the row, ``current`` joins today's product name (deleted → placeholder).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import DELETED_PRODUCT, UNNAMED_SHOP, to_double
from ..schemas import RESTOCKS
from .reports import product_list


def name_order(c: str = "name") -> list[Column]:
    """Case-insensitive name order with a deterministic tie-break."""
    return [F.lower(F.col(c)).asc(), F.col(c).asc()]


def newest_first(date_col: str) -> list[Column]:
    return [F.col(date_col).desc(), F.col("id").desc()]


def products_by_name(products: DataFrame) -> DataFrame:
    """The product list (prices as doubles)."""
    return product_list(products)


def lookup_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """S2 (batch form): the product rows named by ``requests(shop_id, product_id)``.

    A semi-join, so each product appears once however often it is asked for;
    the single-id call is ``where(shop_id == s & id == x)``, pushed to the scan.
    """
    keys = requests.select("shop_id", F.col("product_id").alias("id"))
    return product_list(products.join(keys, ["shop_id", "id"], "left_semi"))


def lookup_product(products: DataFrame, shop_id: int, product_id: int) -> DataFrame:
    """0 or 1 row."""
    return product_list(
        products.where((F.col("shop_id") == F.lit(shop_id)) & (F.col("id") == F.lit(product_id))).limit(1)
    )


def sales_history(sales: DataFrame) -> DataFrame:
    """S3: the sales ledger, 7 columns + shop."""
    return sales.select(
        "shop_id",
        "id",
        "product_id",
        "product_name",
        "quantity",
        "sale_date",
        to_double("revenue").alias("revenue"),
        to_double("profit").alias("profit"),
    )


def with_current_product_names(ledger: DataFrame, products: DataFrame, placeholder: str) -> DataFrame:
    """Replace ``product_name`` by the product's current name; rows whose
    product is gone get ``placeholder``.  Product names are joined on the
    (shop, id) key; AQE broadcasts the name list only when it is small."""
    names = products.select(F.col("shop_id").alias("n_shop_id"), F.col("id").alias("n_id"), F.col("name").alias("n_name"))
    j = ledger.join(
        names, (F.col("shop_id") == F.col("n_shop_id")) & (F.col("product_id") == F.col("n_id")), "left"
    )
    return j.withColumn("product_name", F.coalesce(F.col("n_name"), F.lit(placeholder))).drop(
        "n_shop_id", "n_id", "n_name"
    )


def sales_current_names(sales: DataFrame, products: DataFrame) -> DataFrame:
    return sales_history(with_current_product_names(sales, products, DELETED_PRODUCT))


def debt_history(debts: DataFrame, customers: DataFrame, name_mode: str = "snapshot") -> DataFrame:
    """S4 + J3: ledger rows with the customer's phone; null note/phone → ''.
    ``name_mode='current'`` shows the customer's present name ('' without a customer)."""
    c = customers.select(
        F.col("shop_id").alias("c_shop_id"), F.col("id").alias("c_id"), F.col("phone"), F.col("name").alias("c_name")
    )
    shown = F.col("c_name") if name_mode == "current" else F.col("customer_name")
    j = debts.join(c, (F.col("shop_id") == F.col("c_shop_id")) & (F.col("customer_id") == F.col("c_id")), "left")
    return j.select(
        "shop_id",
        "id",
        "customer_id",
        F.coalesce(shown, F.lit("")).alias("customer_name"),
        F.coalesce("phone", F.lit("")).alias("phone"),
        "transaction_type",
        to_double("amount").alias("amount"),
        F.coalesce("note", F.lit("")).alias("note"),
        "transaction_date",
    )


RESTOCK_COLUMNS = RESTOCKS.names


def restock_history(restocks: DataFrame, products: DataFrame | None = None, name_mode: str = "snapshot") -> DataFrame:
    """Restock ledger; ``name_mode='current'`` re-resolves names ('' if deleted)."""
    r = restocks if name_mode == "snapshot" else with_current_product_names(restocks, products, "")
    return r.select(
        *[to_double(c).alias(c) if c == "unit_buy_price" else F.col(c) for c in RESTOCK_COLUMNS]
    )


def customer_list(customers: DataFrame) -> DataFrame:
    """S6."""
    return customers.select("shop_id", "id", "name", "phone")


def debt_rows(debts: DataFrame) -> DataFrame:
    """Raw ledger rows, 6 columns + shop."""
    return debts.select(
        "shop_id",
        "id",
        "customer_id",
        "transaction_type",
        to_double("amount").alias("amount"),
        "note",
        "transaction_date",
    )


def profile_with_shop(profiles: DataFrame, shops: DataFrame) -> DataFrame:
    """Each profile with its shop's name (fallback label when the shop is missing)."""
    s = shops.select(F.col("id").alias("s_id"), F.col("name").alias("s_name"))
    j = profiles.join(s, F.col("shop_id") == F.col("s_id"), "left")
    return j.select(
        "id", "shop_id", "full_name", "role", F.coalesce("s_name", F.lit(UNNAMED_SHOP)).alias("shop_name")
    )
