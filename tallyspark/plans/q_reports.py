"""Report queries (A*, R1, P7-P22) over the driver tables."""

from __future__ import annotations

from ..operators import reports as R
from ..sources import fixtures as fx
from .oracle_tables import T, with_tables
from .registry import query

TODAY = fx.TODAY
WEEK_START = f"DATE '{R.week_start(TODAY).isoformat()}'"
PYROUND1 = "CAST(format('{{:.1f}}', {x}) AS DOUBLE)"

SUMMARY = (
    "SELECT shop_id, product_name, CAST(sum(quantity) AS BIGINT) AS units_sold, "
    "sum(revenue) AS revenue, sum(profit) AS profit FROM {src} WHERE product_name IS NOT NULL "
    "AND sale_date IS NOT NULL GROUP BY shop_id, product_name"
)


def _ranking_sql(src: str, first: str, k: int) -> str:
    return (
        "SELECT shop_id, rank, product_name, units_sold, CAST(revenue AS DOUBLE) AS revenue, "
        "CAST(profit AS DOUBLE) AS profit FROM (SELECT *, CAST(row_number() OVER (PARTITION BY shop_id "
        f"ORDER BY {first} DESC, revenue DESC, product_name ASC) AS INTEGER) AS rank "
        f"FROM ({SUMMARY.format(src=src)}) s) r WHERE rank <= {k}"
    )


WEEK_SRC = f"(SELECT * FROM t_sales WHERE sale_date BETWEEN {WEEK_START} AND {T})"


@query("top_selling_products", with_tables(_ranking_sql("t_sales", "units_sold", 10), "t_sales"))
def top_selling_products(t):
    """A2: per-shop top 10 by units, then revenue."""
    return R.top_selling_products(fx.sales(t), 10)


RECO_BODY = (
    f"""
    SELECT shop_id, product_id, name, category, stock_quantity, low_stock_threshold, units_sold_7d,
           round(avg_raw, 2) AS average_daily_sales,
           {PYROUND1.format(x='days_raw')} AS estimated_days_until_stockout,
           CASE WHEN low AND soon THEN '{R.LOW_AND_SOON}' WHEN low THEN '{R.LOW_ONLY}'
                ELSE '{R.SOON_ONLY}' END AS recommendation_reason
    FROM (
      SELECT *, stock_quantity <= low_stock_threshold AS low, coalesce(days_raw < 3, false) AS soon
      FROM (
        SELECT p.shop_id, p.id AS product_id, p.name, p.category, p.stock_quantity, p.low_stock_threshold,
               CAST(coalesce(u.units, 0) AS INTEGER) AS units_sold_7d,
               CAST(coalesce(u.units, 0) AS DOUBLE) / 7.0 AS avg_raw,
               CASE WHEN coalesce(u.units, 0) > 0
                    THEN CAST(p.stock_quantity AS DOUBLE) / (CAST(u.units AS DOUBLE) / 7.0) END AS days_raw
        FROM t_products p
        LEFT JOIN (SELECT shop_id, product_id, sum(quantity) AS units FROM t_sales
                   WHERE sale_date BETWEEN {T} - INTERVAL 6 DAY AND {T} AND product_id IS NOT NULL
                   GROUP BY shop_id, product_id) u
          ON p.shop_id = u.shop_id AND p.id = u.product_id
      ) a
    ) b
    WHERE low OR soon
    """
)
RECO_SQL = with_tables(RECO_BODY, "t_products", "t_sales")


@query("restock_recommendations", RECO_SQL)
def restock_recommendations(t):
    """Restocking recommendations for every shop, ordered as the reference lists them."""
    return R.restock_recommendations(fx.products(t), fx.sales(t), TODAY).orderBy(
        "shop_id", *R.recommendation_order()
    )


DASH_SQL = with_tables(
    f"""
    SELECT s.id AS shop_id,
           CAST(coalesce(a.today_revenue, 0) AS DOUBLE) AS today_revenue,
           CAST(coalesce(a.today_profit, 0) AS DOUBLE) AS today_profit,
           CAST(coalesce(b.total_stock_value, 0) AS DOUBLE) AS total_stock_value,
           CAST(coalesce(b.low_stock_count, 0) AS BIGINT) AS low_stock_count
    FROM t_shops s
    LEFT JOIN (SELECT shop_id, sum(revenue) AS today_revenue, sum(profit) AS today_profit
               FROM t_sales WHERE sale_date = {T} GROUP BY shop_id) a ON a.shop_id = s.id
    LEFT JOIN (SELECT shop_id, sum(buy_price * stock_quantity) AS total_stock_value,
                      count(*) FILTER (WHERE stock_quantity <= low_stock_threshold) AS low_stock_count
               FROM t_products GROUP BY shop_id) b ON b.shop_id = s.id
    """,
    "t_shops",
    "t_sales",
    "t_products",
)


@query("dashboard_metrics", DASH_SQL)
def dashboard_metrics(t):
    """A1: today's revenue and profit, stock value, low-stock count per shop."""
    return R.dashboard_metrics(fx.shops(t), fx.products(t), fx.sales(t), TODAY)


WEEKLY_SQL = with_tables(
    f"""
    SELECT s.id AS shop_id, {WEEK_START} AS week_start, {T} AS week_end,
           CAST(coalesce(w.revenue, 0) AS DOUBLE) AS revenue, CAST(coalesce(w.profit, 0) AS DOUBLE) AS profit,
           CAST(coalesce(w.sales_count, 0) AS BIGINT) AS sales_count
    FROM t_shops s LEFT JOIN (SELECT shop_id, sum(revenue) AS revenue, sum(profit) AS profit,
                                     count(*) AS sales_count FROM {WEEK_SRC} w0 GROUP BY shop_id) w
      ON w.shop_id = s.id
    """,
    "t_shops",
    "t_sales",
)


@query("weekly_totals", WEEKLY_SQL)
def weekly_totals(t):
    """A3: week-to-date revenue, profit and sale count per shop."""
    return R.weekly_totals(fx.shops(t), fx.sales(t), TODAY)


@query("weekly_top_products", with_tables(_ranking_sql(WEEK_SRC + " w0", "units_sold", 5), "t_sales"))
def weekly_top_products(t):
    """This week's top 5 by units."""
    return R.weekly_top_products(fx.sales(t), TODAY)


@query("weekly_highest_profit", with_tables(_ranking_sql(WEEK_SRC + " w0", "profit", 5), "t_sales"))
def weekly_highest_profit(t):
    """This week's top 5 by profit."""
    return R.weekly_highest_profit(fx.sales(t), TODAY)


@query(
    "week_sales",
    with_tables(
        "SELECT shop_id, id, product_id, product_name, quantity, sale_date, CAST(revenue AS DOUBLE) AS revenue, "
        f"CAST(profit AS DOUBLE) AS profit FROM {WEEK_SRC} w0",
        "t_sales",
    ),
)
def week_sales(t):
    """The week-to-date sale rows."""
    from ..functions.expr import to_double

    return R.week_sales(fx.sales(t), TODAY).select(
        "shop_id", "id", "product_id", "product_name", "quantity", "sale_date",
        to_double("revenue").alias("revenue"), to_double("profit").alias("profit"),
    )


@query(
    "units_sold_7d",
    with_tables(
        "SELECT shop_id, product_id, CAST(sum(quantity) AS BIGINT) AS units_sold_7d FROM t_sales "
        f"WHERE sale_date BETWEEN {T} - INTERVAL 6 DAY AND {T} AND product_id IS NOT NULL GROUP BY shop_id, product_id",
        "t_sales",
    ),
)
def units_sold_7d(t):
    """A4: units per product over the last 7 days."""
    return R.units_sold_7d(fx.sales(t), TODAY)


BAL = (
    "SELECT c.shop_id, c.id AS customer_id, c.name AS customer_name, coalesce(c.phone, '') AS phone, "
    "coalesce(d.d, 0) AS total_debt, coalesce(d.p, 0) AS total_paid, "
    "coalesce(d.d, 0) - coalesce(d.p, 0) AS remaining_balance FROM t_customers c LEFT JOIN ("
    "SELECT shop_id, customer_id, sum(CASE WHEN transaction_type = 'debt' THEN amount ELSE 0 END) AS d, "
    "sum(CASE WHEN transaction_type = 'payment' THEN amount ELSE 0 END) AS p FROM t_debts "
    "GROUP BY shop_id, customer_id) d ON d.shop_id = c.shop_id AND d.customer_id = c.id"
)
BAL_D = (
    "SELECT shop_id, customer_id, customer_name, phone, CAST(total_debt AS DOUBLE) AS total_debt, "
    "CAST(total_paid AS DOUBLE) AS total_paid, CAST(remaining_balance AS DOUBLE) AS remaining_balance "
    f"FROM ({BAL}) b"
)


@query("customer_balances", with_tables(BAL_D, "t_customers", "t_debts"))
def customer_balances(t):
    """A5: debt, paid and remaining per customer, largest balance first."""
    return R.customer_balances(fx.customers(t), fx.debts(t)).orderBy("shop_id", *R.balance_order())


@query(
    "debt_pivot",
    with_tables(
        "SELECT shop_id, customer_id, CAST(coalesce(sum(amount) FILTER (WHERE transaction_type = 'debt'), 0) AS DOUBLE) "
        "AS debt, CAST(coalesce(sum(amount) FILTER (WHERE transaction_type = 'payment'), 0) AS DOUBLE) AS payment "
        "FROM t_debts GROUP BY shop_id, customer_id",
        "t_debts",
    ),
)
def debt_pivot(t):
    """Pivot of amounts by transaction type."""
    return R.debt_pivot(fx.debts(t))


@query(
    "total_unpaid_debt",
    with_tables(
        "SELECT s.id AS shop_id, CAST(coalesce(u.total_unpaid, 0) AS DOUBLE) AS total_unpaid FROM t_shops s "
        f"LEFT JOIN (SELECT shop_id, sum(greatest(remaining_balance, 0)) AS total_unpaid FROM ({BAL}) b "
        "GROUP BY shop_id) u ON u.shop_id = s.id",
        "t_shops",
        "t_customers",
        "t_debts",
    ),
)
def total_unpaid_debt(t):
    """Total unpaid debt per shop (negative balances count 0)."""
    return R.total_unpaid_debt(fx.shops(t), fx.customers(t), fx.debts(t))


@query(
    "customer_balance_one",
    with_tables(
        f"SELECT * FROM ({BAL_D}) x WHERE (shop_id, customer_id) IN "
        f"(SELECT shop_id, customer_id FROM t_debts WHERE transaction_date = {T})",
        "t_customers",
        "t_debts",
    ),
)
def customer_balance_one(t):
    """Balances of the customers who had a ledger row today (batch lookup)."""
    from pyspark.sql import functions as F

    from ..functions.expr import date_lit

    d = fx.debts(t)
    requests = d.where(F.col("transaction_date") == date_lit(TODAY)).select("shop_id", "customer_id")
    return R.customer_balance_lookup(fx.customers(t), d, requests)


@query("unpaid_customers", with_tables(f"SELECT * FROM ({BAL_D}) x WHERE remaining_balance > 0", "t_customers", "t_debts"))
def unpaid_customers(t):
    """P10: customers who still owe money."""
    return R.unpaid_customers(fx.customers(t), fx.debts(t))


@query(
    "balance_labels",
    with_tables(
        "SELECT shop_id, customer_id, customer_name, "
        "format('{:,.2f}', CAST(remaining_balance AS DOUBLE)) || ' MAD' AS balance_label "
        f"FROM ({BAL}) b",
        "t_customers",
        "t_debts",
    ),
)
def balance_labels(t):
    """Balances as money text."""
    return R.balance_labels(fx.customers(t), fx.debts(t))


PRODUCT_LIST = (
    "SELECT shop_id, id, name, category, CAST(buy_price AS DOUBLE) AS buy_price, "
    "CAST(sell_price AS DOUBLE) AS sell_price, stock_quantity, low_stock_threshold FROM {src}"
)


@query(
    "low_stock_products",
    with_tables(PRODUCT_LIST.format(src="t_products WHERE stock_quantity <= low_stock_threshold"), "t_products"),
)
def low_stock_products(t):
    """Products at or below their threshold, lowest stock first."""
    return R.low_stock_products(fx.products(t)).orderBy("shop_id", "stock_quantity", "name")


@query(
    "low_stock_view",
    with_tables(PRODUCT_LIST.format(src="t_products WHERE stock_quantity <= low_stock_threshold"), "t_products"),
)
def low_stock_view(t):
    """Dashboard low-stock table."""
    return R.low_stock_view(fx.products(t))


@query(
    "sale_amounts",
    with_tables(
        "SELECT c.shop_id, c.id, c.product_id, c.quantity, CAST(p.sell_price * c.quantity AS DOUBLE) AS revenue, "
        "CAST((p.sell_price - p.buy_price) * c.quantity AS DOUBLE) AS profit FROM t_sale_commands c "
        "JOIN t_products p ON p.shop_id = c.shop_id AND p.id = c.product_id",
        "t_sale_commands",
        "t_products",
    ),
)
def sale_amounts(t):
    """Revenue and profit of every sale request at the product's prices."""
    return R.sale_amounts(fx.products(t), fx.sale_commands(t))


@query(
    "restock_export",
    with_tables(
        "SELECT shop_id, id, product_name, quantity_added, supplier_name, CAST(unit_buy_price AS DOUBLE) AS unit_buy_price, "
        "strftime(restock_date, '%Y-%m-%d') AS restock_date, "
        "CASE WHEN updated_buy_price THEN 'Yes' WHEN NOT updated_buy_price THEN 'No' END AS updated_buy_price "
        "FROM t_restocks",
        "t_restocks",
    ),
)
def restock_export(t):
    """Restock rows with the price flag as Yes/No."""
    return R.restock_export(fx.restocks(t))


@query(
    "sales_with_dates",
    with_tables(
        "SELECT shop_id, id, product_id, product_name, quantity, d AS sale_date, CAST(revenue AS DOUBLE) AS revenue, "
        "CAST(profit AS DOUBLE) AS profit FROM (SELECT *, CAST(try_strptime(sale_date, '%Y-%m-%d') AS DATE) AS d "
        "FROM t_sales_text) x WHERE d IS NOT NULL",
        "t_sales_text",
    ),
)
def sales_with_dates(t):
    """P5: text dates parsed; unparsable rows dropped."""
    from ..functions.expr import to_double

    return R.parse_sale_dates(fx.sales_text_dates(t)).select(
        "shop_id", "id", "product_id", "product_name", "quantity", "sale_date",
        to_double("revenue").alias("revenue"), to_double("profit").alias("profit"),
    )


@query(
    "coerce_products",
    with_tables(
        "SELECT shop_id, seq, name, CAST(coalesce(TRY_CAST(trim(buy_price) AS DECIMAL(12,2)), 0) AS DOUBLE) AS buy_price, "
        "CAST(coalesce(TRY_CAST(trim(sell_price) AS DECIMAL(12,2)), 0) AS DOUBLE) AS sell_price, "
        "CAST(coalesce(trunc(TRY_CAST(trim(stock_quantity) AS DOUBLE)), 0) AS INTEGER) AS stock_quantity, "
        "CAST(coalesce(trunc(TRY_CAST(trim(low_stock_threshold) AS DOUBLE)), 0) AS INTEGER) AS low_stock_threshold "
        "FROM t_product_text",
        "t_product_text",
    ),
)
def coerce_products(t):
    """Numeric text coerced, bad values → 0."""
    return R.coerce_products(fx.product_text_rows(t))


@query(
    "clean_customers",
    with_tables(
        "SELECT shop_id, seq, nullif(trim(customer_name), '') AS customer_name, nullif(trim(phone), '') AS phone "
        "FROM t_debt_commands",
        "t_debt_commands",
    ),
)
def clean_customers(t):
    """Trimmed customer input, blank → null."""
    return R.clean_customer_input(fx.debt_commands(t))
