"""Scan, lookup, history and CSV queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import date_lit
from ..operators import history as H
from ..schemas import CUSTOMERS, DEBTS, PRODUCTS, RESTOCKS, SALES
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from .oracle_tables import T, with_tables
from .q_reports import PRODUCT_LIST
from .registry import query

SALES_D = (
    "SELECT shop_id, id, product_id, product_name, quantity, sale_date, CAST(revenue AS DOUBLE) AS revenue, "
    "CAST(profit AS DOUBLE) AS profit FROM {src}"
)
RESTOCK_D = (
    "SELECT shop_id, id, product_id, product_name, quantity_added, supplier_name, "
    "CAST(unit_buy_price AS DOUBLE) AS unit_buy_price, restock_date, updated_buy_price FROM {src}"
)


@query("scan_products", with_tables(PRODUCT_LIST.format(src="t_products"), "t_products"))
def scan_products(t):
    """Products ordered by name (case-insensitive)."""
    return H.products_by_name(fx.products(t)).orderBy("shop_id", *H.name_order())


@query(
    "lookup_product",
    with_tables(
        PRODUCT_LIST.format(
            src=f"t_products WHERE (shop_id, id) IN (SELECT shop_id, product_id FROM t_sales WHERE sale_date = {T})"
        ),
        "t_products",
        "t_sales",
    ),
)
def lookup_product(t):
    """Product rows for every product sold today (batch point lookup)."""
    s = fx.sales(t)
    return H.lookup_products(fx.products(t), s.where(F.col("sale_date") == date_lit(fx.TODAY)))


@query("scan_sales", with_tables(SALES_D.format(src="t_sales"), "t_sales"))
def scan_sales(t):
    """S3: sales history, newest first."""
    return H.sales_history(fx.sales(t)).orderBy("shop_id", *H.newest_first("sale_date"))


@query(
    "debt_history",
    with_tables(
        "SELECT d.shop_id, d.id, d.customer_id, coalesce(d.customer_name, '') AS customer_name, "
        "coalesce(c.phone, '') AS phone, d.transaction_type, CAST(d.amount AS DOUBLE) AS amount, "
        "coalesce(d.note, '') AS note, d.transaction_date FROM t_debts d "
        "LEFT JOIN t_customers c ON c.shop_id = d.shop_id AND c.id = d.customer_id",
        "t_debts",
        "t_customers",
    ),
)
def debt_history(t):
    """Debt ledger with phone, newest first."""
    return H.debt_history(fx.debts(t), fx.customers(t)).orderBy("shop_id", *H.newest_first("transaction_date"))


@query(
    "debt_history_current_names",
    with_tables(
        "SELECT d.shop_id, d.id, d.customer_id, coalesce(c.name, '') AS customer_name, "
        "coalesce(c.phone, '') AS phone, d.transaction_type, CAST(d.amount AS DOUBLE) AS amount, "
        "coalesce(d.note, '') AS note, d.transaction_date FROM t_debts d "
        "LEFT JOIN (SELECT c0.* FROM t_customers c0 WHERE NOT EXISTS (SELECT 1 FROM t_customer_deletes x "
        "WHERE x.shop_id = c0.shop_id AND x.id = c0.id)) c ON c.shop_id = d.shop_id AND c.id = d.customer_id",
        "t_debts",
        "t_customers",
        "t_customer_deletes",
    ),
)
def debt_history_current_names(t):
    """S4 (D11): debt ledger with present customer names; '' for deleted customers."""
    customers = fx.customers(t).join(fx.customer_deletes(t), ["shop_id", "id"], "left_anti")
    return H.debt_history(fx.debts(t), customers, name_mode="current").orderBy(
        "shop_id", *H.newest_first("transaction_date")
    )


@query("restock_history", with_tables(RESTOCK_D.format(src="t_restocks"), "t_restocks"))
def restock_history(t):
    """Restock ledger (snapshot names), newest first."""
    return H.restock_history(fx.restocks(t)).orderBy("shop_id", *H.newest_first("restock_date"))


@query("scan_customers", with_tables("SELECT shop_id, id, name, phone FROM t_customers", "t_customers"))
def scan_customers(t):
    """Customers by name."""
    return H.customer_list(fx.customers(t)).orderBy("shop_id", *H.name_order())


@query(
    "scan_debts",
    with_tables(
        "SELECT shop_id, id, customer_id, transaction_type, CAST(amount AS DOUBLE) AS amount, note, "
        "transaction_date FROM t_debts",
        "t_debts",
    ),
)
def scan_debts(t):
    """Raw debt rows, newest first."""
    return H.debt_rows(fx.debts(t)).orderBy("shop_id", *H.newest_first("transaction_date"))


@query(
    "profile_with_shop",
    with_tables(
        "SELECT p.id, p.shop_id, p.full_name, p.role, coalesce(s.name, 'Unnamed shop') AS shop_name "
        "FROM t_profiles p LEFT JOIN t_shops s ON s.id = p.shop_id",
        "t_profiles",
        "t_shops",
    ),
)
def profile_with_shop(t):
    """Each profile with its shop name."""
    return H.profile_with_shop(fx.profiles(t), fx.shops(t))


DELETED = "t_products_after_delete"
PRODUCTS_AFTER_DELETE = (
    "SELECT * FROM t_products p WHERE NOT EXISTS (SELECT 1 FROM t_discontinued d "
    "WHERE d.shop_id = p.shop_id AND d.id = p.id)"
)


def _products_after_delete(t):
    from ..operators import ledger as L

    return L.delete_products(fx.products(t), fx.discontinued_products(t))


@query(
    "sales_current_names",
    with_tables(
        SALES_D.format(
            src="(SELECT s.shop_id, s.id, s.product_id, coalesce(p.name, 'Deleted product') AS product_name, "
            "s.quantity, s.sale_date, s.revenue, s.profit FROM t_sales s LEFT JOIN "
            f"({PRODUCTS_AFTER_DELETE}) p ON p.shop_id = s.shop_id AND p.id = s.product_id) x"
        ),
        "t_sales",
        "t_products",
        "t_discontinued",
    ),
)
def sales_current_names(t):
    """Sales with today's product names after a delete batch (placeholder if gone)."""
    return H.sales_current_names(fx.sales(t), _products_after_delete(t))


@query(
    "restocks_current_names",
    with_tables(
        RESTOCK_D.format(
            src="(SELECT r.shop_id, r.id, r.product_id, coalesce(p.name, '') AS product_name, r.quantity_added, "
            "r.supplier_name, r.unit_buy_price, r.restock_date, r.updated_buy_price FROM t_restocks r LEFT JOIN "
            f"({PRODUCTS_AFTER_DELETE}) p ON p.shop_id = r.shop_id AND p.id = r.product_id) x"
        ),
        "t_restocks",
        "t_products",
        "t_discontinued",
    ),
)
def restocks_current_names(t):
    """Restocks with current names ('' when the product is gone)."""
    return H.restock_history(fx.restocks(t), _products_after_delete(t), name_mode="current")


def _roundtrip(t, df, schema, name):
    path = scratch_path(t.spark, f"csv-{name}")
    sinks.write_csv(df, path)
    return sinks.read_csv(t.spark, path, schema)


@query("csv_roundtrip_products", with_tables("SELECT * FROM t_products", "t_products"))
def csv_roundtrip_products(t):
    """Product export to CSV and back."""
    return _roundtrip(t, fx.products(t), PRODUCTS, "products")


@query("csv_roundtrip_sales", with_tables("SELECT * FROM t_sales", "t_sales"))
def csv_roundtrip_sales(t):
    """Sales export to CSV and back."""
    return _roundtrip(t, fx.sales(t), SALES, "sales")


@query("csv_roundtrip_debts", with_tables("SELECT * FROM t_debts", "t_debts"))
def csv_roundtrip_debts(t):
    """Debt ledger export to CSV and back."""
    return _roundtrip(t, fx.debts(t), DEBTS, "debts")


@query("csv_roundtrip_restocks", with_tables("SELECT * FROM t_restocks", "t_restocks"))
def csv_roundtrip_restocks(t):
    """Restock ledger export to CSV and back."""
    return _roundtrip(t, fx.restocks(t), RESTOCKS, "restocks")


@query("csv_roundtrip_customers", with_tables("SELECT * FROM t_customers", "t_customers"))
def csv_roundtrip_customers(t):
    """Customer export to CSV and back (null phone stays null)."""
    return _roundtrip(t, fx.customers(t), CUSTOMERS, "customers")


# ---------------------------------------------------------------- S10-S12 stored tables


@query("tables_roundtrip_products", with_tables("SELECT * FROM t_products", "t_products"))
def tables_roundtrip_products(t):
    """Tables created empty, products reloaded twice, the current version read."""
    root = scratch_path(t.spark, "tables-products")
    sinks.create_tables(t.spark, root)
    sinks.reset_tables(t.spark, root, {"products": fx.discontinued_products(t).join(fx.products(t), ["shop_id", "id"])})
    sinks.reset_tables(t.spark, root, {"products": fx.products(t)})
    return sinks.read_table(t.spark, root, "products")


@query("tables_roundtrip_restocks", with_tables("SELECT * FROM t_restocks", "t_restocks"))
def tables_roundtrip_restocks(t):
    """A ledger reloaded wholesale and read back."""
    root = scratch_path(t.spark, "tables-restocks")
    sinks.reset_tables(t.spark, root, {"restocks": fx.restocks(t)})
    return sinks.read_table(t.spark, root, "restocks")


@query("ledger_append_replayed", with_tables("SELECT * FROM t_sales", "t_sales"))
def ledger_append_replayed(t):
    """The sales appended as two batches, one of them twice."""
    root, sales = scratch_path(t.spark, "ledger-append"), fx.sales(t)
    sinks.create_tables(t.spark, root)
    small = F.col("quantity") < 25
    sinks.append_rows(t.spark, root, "sales", sales.where(small), batch_id=1)
    for _ in range(2):
        sinks.append_rows(t.spark, root, "sales", sales.where(~small), batch_id=2)
    return sinks.read_table(t.spark, root, "sales")


@query("stored_sales_for_shop", with_tables(SALES_D.format(src="t_sales WHERE shop_id = 7"), "t_sales"))
def stored_sales_for_shop(t):
    """One shop's sales from a written ledger (the shop prunes files and row groups)."""
    from ..operators import reports as R

    root = scratch_path(t.spark, "stored-sales")
    sinks.reset_tables(t.spark, root, {"sales": fx.sales(t)})
    return H.sales_history(R.for_shop(sinks.read_table(t.spark, root, "sales"), 7))
