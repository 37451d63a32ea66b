"""Policies and deletes on written ledgers, and row time stamps."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import ledger as L
from ..operators import stamps as ST
from ..operators import tenant as TN
from ..schemas import DEBTS, SALES
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from .oracle_tables import with_tables
from .q_ledger import SALE_FOLD, UPD_CTE, UPSERT
from .q_tenant import CALLER
from .registry import ORACLES, query

SHOP_BUCKETS = 16
PRUNED_BUCKETS = 4  # a ledger has this many folders a month
LOADED, APPLIED = datetime(2001, 1, 1), datetime(2001, 2, 3, 4, 5, 6)
STAMP_SQL = "TIMESTAMP '{0}' AS created_at, CASE WHEN {1} THEN TIMESTAMP '{2}' ELSE TIMESTAMP '{0}' END AS updated_at"


@query("rls_caller_sales_stored", ORACLES["rls_caller_sales"])
def rls_caller_sales_stored(t):
    """P1/P2 on a written ledger: the caller's profile prunes the shop-bucket folders at run time."""
    path = scratch_path(t.spark, "rls-ledger")
    sinks.write_ledger(fx.sales(t), path, "sale_date", shop_buckets=PRUNED_BUCKETS)
    ledger = sinks.read_ledger(t.spark, path, SALES, "sale_date", shop_buckets=True)
    return H.sales_history(TN.stored_rows_for_caller(ledger, fx.profiles(t), CALLER, PRUNED_BUCKETS))


@query("sales_after_product_delete_stored", ORACLES["sales_after_product_delete"])
def sales_after_product_delete_stored(t):
    """M3 on a written ledger: only the shop buckets that hold a deleted product's shop are rewritten."""
    path = scratch_path(t.spark, "stored-sales")
    sinks.write_buckets(t.spark, fx.sales(t), path, ["shop_id"], ["shop_id", "sale_date", "id"], SHOP_BUCKETS)
    L.null_refs_stored(t.spark, path, SALES, fx.products(t), fx.discontinued_products(t), ["shop_id", "sale_date", "id"])
    return H.sales_history(sinks.read_snapshot(t.spark, path, SALES))


@query("cascade_customer_delete_stored", ORACLES["cascade_customer_delete"])
def cascade_customer_delete_stored(t):
    """M3b on a written ledger: debt rows of deleted customers leave the shop buckets that hold them."""
    path = scratch_path(t.spark, "stored-debts")
    by = ["shop_id", "transaction_date", "id"]
    sinks.write_buckets(t.spark, fx.debts(t), path, ["shop_id"], by, SHOP_BUCKETS)
    L.cascade_customers_stored(t.spark, path, DEBTS, fx.customer_deletes(t), by)
    return H.debt_rows(sinks.read_snapshot(t.spark, path, DEBTS))


@query(
    "update_products_stamps",
    with_tables(
        UPD_CTE + "SELECT p.shop_id, p.id, " + STAMP_SQL.format(LOADED, "l.id IS NOT NULL", APPLIED)
        + " FROM t_products p LEFT JOIN last l ON l.shop_id = p.shop_id AND l.id = p.id",
        "t_product_updates",
        "t_products",
        recursive=True,
    ),
)
def update_products_stamps(t):
    """products' time stamps after the updates: accepted commands refresh updated_at."""
    before = ST.first_stamps(fx.products(t), LOADED)
    updates = fx.product_updates(t)
    outcomes = L.update_outcomes(fx.products(t), updates, None, True)  # the commands and their verdicts are written, so reading them twice is cheap
    after = L.update_products(fx.products(t), updates, outcomes)
    touched = outcomes.where("accepted").select("shop_id", "id")
    return ST.restamp(before, after, ["shop_id", "id"], touched, APPLIED).select("shop_id", "id", *[f.name for f in ST.STAMPS])


@query(
    "upsert_customers_stamps",
    with_tables(
        UPSERT + "SELECT a.shop_id, a.id, CASE WHEN c.id IS NULL THEN TIMESTAMP '{1}' ELSE TIMESTAMP '{0}' END AS created_at, "
        "CASE WHEN c.id IS NULL OR u.cid IS NOT NULL THEN TIMESTAMP '{1}' ELSE TIMESTAMP '{0}' END AS updated_at FROM after a "
        "LEFT JOIN t_customers c ON c.shop_id = a.shop_id AND c.id = a.id "
        "LEFT JOIN (SELECT k.shop_id, k.cid FROM per_name n JOIN keys k ON k.shop_id = n.shop_id AND k.nk = n.nk "
        "WHERE n.ph IS NOT NULL) u ON u.shop_id = a.shop_id AND u.cid = a.id".format(LOADED, APPLIED),
        "t_debt_commands",
        "t_customers",
    ),
)
def upsert_customers_stamps(t):
    """customers' time stamps after the debts: new ones, and those whose phone a command gives."""
    customers, commands = fx.customers(t), fx.debt_commands(t)
    after = L.upsert_customers(customers, commands)
    touched = L.phone_updates(customers, commands)
    stamped = ST.restamp(ST.first_stamps(customers, LOADED), after, ["shop_id", "id"], touched, APPLIED)
    return stamped.select("shop_id", "id", *[f.name for f in ST.STAMPS])


@query(
    "sales_stock_stamps",
    with_tables(
        SALE_FOLD + "SELECT p.shop_id, p.id, " + STAMP_SQL.format(LOADED, "s.product_id IS NOT NULL", APPLIED)
        + " FROM t_products p LEFT JOIN (SELECT DISTINCT shop_id, product_id FROM outcome WHERE status = 'accepted') s "
        "ON s.shop_id = p.shop_id AND s.product_id = p.id",
        "t_sale_commands",
        "t_products",
        recursive=True,
    ),
)
def sales_stock_stamps(t):
    """products' time stamps after the sales: an accepted sale refreshes its product."""
    products = fx.products(t)
    sold = L.apply_sales(products, fx.sale_commands(t)).where(F.col("status") == L.ACCEPTED)
    touched = sold.select("shop_id", F.col("product_id").alias("id"))
    units = sold.select("shop_id", "product_id", F.col("quantity").alias("units"))
    stamped = ST.restamp(ST.first_stamps(products, LOADED), L.stock_after(products, units, -1), ["shop_id", "id"], touched, APPLIED)
    return stamped.select("shop_id", "id", *[f.name for f in ST.STAMPS])
