"""Generator queries (G1, G2) over the driver tables."""

from __future__ import annotations

from ..operators import generate as G
from ..sources import fixtures as fx
from .oracle_tables import T, with_tables
from .registry import query

TODAY = fx.TODAY

DRAW = (
    f"min_units + ((id * {G.HASH_PRODUCT} + days_ago * {G.HASH_DAY} + shop_id * {G.HASH_SHOP}) "
    f"% {G.HASH_MODULUS}) % (max_units - min_units + 1)"
)


@query(
    "generate_sales",
    with_tables(
        "SELECT shop_id, CAST(id AS VARCHAR) || '-' || strftime(sale_date, '%Y%m%d') AS id, id AS product_id, "
        "name AS product_name, quantity, sale_date, CAST(sell_price * quantity AS DOUBLE) AS revenue, "
        "CAST((sell_price - buy_price) * quantity AS DOUBLE) AS profit FROM ("
        "SELECT *, CAST(CASE WHEN dayofweek(sale_date) IN (0, 6) THEN "
        f"round_even(CAST(raw AS DOUBLE) * CAST({G.WEEKEND_BOOST} AS DOUBLE), 0) ELSE raw END AS INTEGER) AS quantity "
        f"FROM (SELECT *, {DRAW} AS raw, CAST({T} - CAST(days_ago AS INTEGER) AS DATE) AS sale_date FROM ("
        f"SELECT p.*, r.min_units, r.max_units, unnest(generate_series({G.HISTORY_DAYS - 1}, 0, -1)) AS days_ago "
        "FROM t_products p JOIN t_daily_ranges r ON r.shop_id = p.shop_id AND r.product_id = p.id) a) b) c "
        "WHERE quantity > 0",
        "t_products",
        "t_daily_ranges",
    ),
)
def generate_sales(t):
    """G1: 14 days of synthetic sales for every product."""
    return G.generate_sales(fx.products(t), fx.product_daily_ranges(t), TODAY)


@query(
    "generate_relative_dates",
    with_tables(
        "SELECT d.shop_id, d.id, c.id AS customer_id, d.customer_name, d.transaction_type, "
        f"CAST(d.amount AS DOUBLE) AS amount, d.note, CAST({T} - d.days_ago AS DATE) AS transaction_date "
        "FROM t_demo_debts d JOIN (SELECT shop_id, name, max(id) AS id FROM t_customers GROUP BY shop_id, name) c "
        "ON c.shop_id = d.shop_id AND c.name = d.customer_name",
        "t_demo_debts",
        "t_customers",
    ),
)
def generate_relative_dates(t):
    """Debt rows by name and offset → ledger rows with customer ids and dates."""
    from ..functions.expr import to_double

    rows = G.resolve_relative_rows(
        fx.demo_debt_rows(t), fx.customers(t), TODAY, name_col="customer_name", id_col="customer_id",
        date_col="transaction_date",
    )
    return rows.select(
        "shop_id", "id", "customer_id", "customer_name", "transaction_type",
        to_double("amount").alias("amount"), "note", "transaction_date",
    )
