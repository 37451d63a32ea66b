"""Validation and ledger-mutation queries (V1-V6, M1-M9).

The fold oracles are DuckDB recursive CTEs walking each key's commands in
order, one row per step — an independent, obviously-sequential formulation.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.expr import to_double
from ..operators import ledger as L
from ..operators import reports as R
from ..operators import tenant as TN
from ..sources import fixtures as fx
from .oracle_tables import with_tables
from .q_reports import PRODUCT_LIST
from .registry import QUERIES, query

BLANK = "({c} IS NULL OR trim({c}) = '')"
V1 = (
    "concat_ws(';', CASE WHEN " + BLANK.format(c="name") + " THEN 'name_required' END, "
    "CASE WHEN " + BLANK.format(c="category") + " THEN 'category_required' END, "
    "CASE WHEN coalesce(buy_price < 0 OR sell_price < 0, true) THEN 'negative_price' END, "
    "CASE WHEN coalesce(stock_quantity < 0 OR low_stock_threshold < 0, true) THEN 'negative_stock' END)"
)
PRODUCT_D = PRODUCT_LIST  # shop_id, id, name, category, prices as double, stock, threshold


# ---------------------------------------------------------------- V1, V2, M1


@query(
    "validate_products",
    with_tables(
        f"SELECT shop_id, seq, name, reasons, reasons = '' AS accepted FROM (SELECT *, {V1} AS reasons "
        "FROM t_product_requests) x",
        "t_product_requests",
    ),
)
def validate_products(t):
    """V1: product rule checks, every violated rule listed."""
    return L.validate_products(fx.product_requests(t)).select("shop_id", "seq", "name", "reasons", "accepted")


DUP_CTE = (
    f", v AS (SELECT *, lower(trim(name)) AS nk FROM t_product_requests WHERE {V1} = ''), "
    "taken AS (SELECT DISTINCT shop_id, lower(trim(name)) AS nk FROM t_products), "
    "firsts AS (SELECT shop_id, nk, min(seq) AS first FROM v WHERE NOT EXISTS (SELECT 1 FROM taken t "
    "WHERE t.shop_id = v.shop_id AND t.nk = v.nk) GROUP BY shop_id, nk), "
    "dup AS (SELECT v.*, CASE WHEN t.nk IS NOT NULL THEN 'duplicate_name' WHEN v.seq <> f.first "
    "THEN 'duplicate_in_batch' ELSE '' END AS reason FROM v LEFT JOIN taken t ON t.shop_id = v.shop_id AND t.nk = v.nk "
    "LEFT JOIN firsts f ON f.shop_id = v.shop_id AND f.nk = v.nk)\n"
)


@query(
    "duplicate_products",
    with_tables(
        DUP_CTE + "SELECT shop_id, seq, name, reason, reason = '' AS accepted FROM dup",
        "t_product_requests",
        "t_products",
    ),
)
def duplicate_products(t):
    """V2: name uniqueness per shop, case-insensitive, against table and batch."""
    return L.duplicate_products(fx.products(t), fx.product_requests(t))


@query(
    "insert_products",
    with_tables(
        DUP_CTE
        + "SELECT shop_id, (SELECT coalesce(max(id), 0) FROM t_products) + row_number() OVER (ORDER BY seq) AS id, trim(name) AS name, trim(category) AS category, CAST(buy_price AS DOUBLE) AS "
        "buy_price, CAST(sell_price AS DOUBLE) AS sell_price, stock_quantity, low_stock_threshold FROM dup "
        "WHERE reason = ''",
        "t_product_requests",
        "t_products",
    ),
)
def insert_products(t):
    """M1: accepted inserts with their new ids."""
    return R.product_list(L.insert_products(fx.products(t), fx.product_requests(t)))


# ---------------------------------------------------------------- M2, M3


# One command at a time: the state of a shop is the list of its products with their present name keys.
UPD_CTE = (
    f", u0 AS (SELECT *, {V1} AS v1, lower(trim(name)) AS nk, row_number() OVER (PARTITION BY shop_id "
    "ORDER BY command_date, command_id) AS rn FROM t_product_updates), "
    "s0 AS (SELECT shop_id, list({'id': id, 'nk': lower(trim(name))}) AS held FROM t_products GROUP BY shop_id), "
    "uw AS (SELECT shop_id, CAST(0 AS BIGINT) AS rn, CAST('' AS VARCHAR) AS reasons, held FROM s0 UNION ALL "
    "SELECT x.shop_id, x.rn, x.reasons, CASE WHEN x.reasons = '' THEN list_transform(x.held, lambda h: CASE WHEN h.id = x.id "
    "THEN {'id': h.id, 'nk': x.nk} ELSE h END) ELSE x.held END AS held FROM ("
    "SELECT c.shop_id, c.rn, c.id, c.nk, w.held, concat_ws(';', CASE WHEN c.v1 <> '' THEN c.v1 END, "
    "CASE WHEN len(list_filter(w.held, lambda h: h.id = c.id)) = 0 THEN 'not_found' END, "
    "CASE WHEN len(list_filter(w.held, lambda h: h.nk = c.nk AND h.id <> c.id)) > 0 THEN 'duplicate_name' END) AS reasons "
    "FROM uw w JOIN u0 c ON c.shop_id = w.shop_id AND c.rn = w.rn + 1) x), "
    "u AS (SELECT c.*, w.reasons FROM u0 c JOIN uw w ON w.shop_id = c.shop_id AND w.rn = c.rn), "
    "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shop_id, id ORDER BY command_date DESC, "
    "command_id DESC) AS nth FROM u WHERE reasons = '') y WHERE nth = 1)\n"
)


@query(
    "update_outcomes",
    with_tables(
        UPD_CTE + "SELECT shop_id, id, command_date, command_id, name, reasons, reasons = '' AS accepted FROM u",
        "t_product_updates",
        "t_products",
        recursive=True,
    ),
)
def update_outcomes(t):
    """M2: every update command with its verdict, names resolved in command order."""
    return L.update_outcomes(fx.products(t), fx.product_updates(t), ["shop_id", "id", "command_date", "command_id", "name"])


@query(
    "update_products",
    with_tables(
        UPD_CTE
        + PRODUCT_D.format(
            src="(SELECT p.shop_id, p.id, coalesce(trim(l.name), p.name) AS name, "
            "coalesce(trim(l.category), p.category) AS category, coalesce(l.buy_price, p.buy_price) AS buy_price, "
            "coalesce(l.sell_price, p.sell_price) AS sell_price, coalesce(l.stock_quantity, p.stock_quantity) "
            "AS stock_quantity, coalesce(l.low_stock_threshold, p.low_stock_threshold) AS low_stock_threshold "
            "FROM t_products p LEFT JOIN last l ON l.shop_id = p.shop_id AND l.id = p.id) z"
        ),
        "t_product_updates",
        "t_products",
        recursive=True,
    ),
)
def update_products(t):
    """M2: product snapshot after full-row updates (last accepted per id wins)."""
    return R.product_list(L.update_products(fx.products(t), fx.product_updates(t)))


@query(
    "delete_products",
    with_tables(
        PRODUCT_D.format(
            src="t_products p WHERE NOT EXISTS (SELECT 1 FROM t_discontinued d WHERE d.shop_id = p.shop_id "
            "AND d.id = p.id)"
        ),
        "t_products",
        "t_discontinued",
    ),
)
def delete_products(t):
    """M3: products after a delete batch."""
    return R.product_list(L.delete_products(fx.products(t), fx.discontinued_products(t)))


@query(
    "delete_outcomes",
    with_tables(
        "SELECT d.shop_id, d.id, CASE WHEN p.id IS NULL THEN 'rejected' ELSE 'accepted' END AS status, "
        "CASE WHEN p.id IS NULL THEN 'not_found' ELSE '' END AS reason FROM (SELECT DISTINCT * FROM t_discontinued) d "
        "LEFT JOIN t_products p ON p.shop_id = d.shop_id AND p.id = d.id",
        "t_products",
        "t_discontinued",
    ),
)
def delete_outcomes(t):
    """M3: every delete request, unknown ids rejected."""
    return L.delete_outcomes(fx.products(t), fx.discontinued_products(t))


@query(
    "sales_after_product_delete",
    with_tables(
        "SELECT s.shop_id, s.id, CASE WHEN d.id IS NULL THEN s.product_id END AS product_id, s.product_name, "
        "s.quantity, s.sale_date, CAST(s.revenue AS DOUBLE) AS revenue, CAST(s.profit AS DOUBLE) AS profit "
        "FROM t_sales s LEFT JOIN (SELECT DISTINCT d.shop_id, d.id FROM t_discontinued d JOIN t_products p "
        "ON p.shop_id = d.shop_id AND p.id = d.id) d ON d.shop_id = s.shop_id AND d.id = s.product_id",
        "t_sales",
        "t_discontinued",
        "t_products",
    ),
)
def sales_after_product_delete(t):
    """M3: ledger keeps names, loses the id of deleted products (SET NULL)."""
    from ..operators import history as H

    return H.sales_history(L.null_deleted_refs(fx.sales(t), fx.products(t), fx.discontinued_products(t)))


@query(
    "cascade_customer_delete",
    with_tables(
        "SELECT shop_id, id, customer_id, transaction_type, CAST(amount AS DOUBLE) AS amount, note, transaction_date "
        "FROM t_debts d WHERE NOT EXISTS (SELECT 1 FROM t_customer_deletes x WHERE x.shop_id = d.shop_id "
        "AND x.id = d.customer_id)",
        "t_debts",
        "t_customer_deletes",
    ),
)
def cascade_customer_delete(t):
    """Debt rows after deleting the customers of one segment."""
    from ..operators import history as H

    return H.debt_rows(L.cascade_customer_delete(fx.debts(t), fx.customer_deletes(t)))


CASCADE_TABLES = {"products": fx.products, "sales": fx.sales, "customers": fx.customers, "debts": fx.debts, "restocks": fx.restocks}
CASCADE_MONEY = ("buy_price", "sell_price", "revenue", "profit", "amount", "unit_buy_price")


def _cascade(name: str, table) -> None:
    replace = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in CASCADE_MONEY if c in SCHEMAS[name].names)

    @query(
        f"cascade_shop_delete_{name}",
        with_tables(
            f"SELECT {f'* REPLACE ({replace})' if replace else '*'} FROM t_{name} x WHERE EXISTS "
            "(SELECT 1 FROM t_profiles p WHERE p.shop_id = x.shop_id) OR NOT EXISTS (SELECT 1 FROM t_shops s "
            "WHERE s.id = x.shop_id)",
            "t_shops",
            "t_profiles",
            f"t_{name}",
        ),
    )
    def rows_left(t):
        checked = TN.shop_delete_check(fx.shop_delete_requests(t), fx.profiles(t))
        gone = checked.where(F.col("accepted")).select("shop_id")
        left = L.cascade_shop_delete({name: table(t)}, gone)[name]
        return left.withColumns({c: to_double(c) for c in CASCADE_MONEY if c in left.columns})

    QUERIES[f"cascade_shop_delete_{name}"].__doc__ = f"M3b: {name} rows left after deleting every shop no profile uses."


SCHEMAS = {"products": S.PRODUCTS, "sales": S.SALES, "customers": S.CUSTOMERS, "debts": S.DEBTS, "restocks": S.RESTOCKS}
for _name, _table in CASCADE_TABLES.items():
    _cascade(_name, _table)


# ---------------------------------------------------------------- M4 sales


SALE_FOLD = (
    ", j AS (SELECT c.shop_id, c.id, c.product_id, p.name AS product_name, c.quantity, c.command_date AS sale_date, "
    "p.stock_quantity, p.buy_price, p.sell_price, p.id IS NULL AS missing FROM t_sale_commands c "
    "LEFT JOIN t_products p ON p.shop_id = c.shop_id AND p.id = c.product_id), "
    "good AS (SELECT *, row_number() OVER (PARTITION BY shop_id, product_id ORDER BY sale_date, id) AS rn FROM j "
    "WHERE NOT missing AND coalesce(quantity, 0) > 0), "
    "walk AS (SELECT shop_id, product_id, rn, quantity <= stock_quantity AS ok, "
    "CASE WHEN quantity <= stock_quantity THEN stock_quantity - quantity ELSE stock_quantity END AS lvl "
    "FROM good WHERE rn = 1 UNION ALL SELECT g.shop_id, g.product_id, g.rn, g.quantity <= w.lvl, "
    "CASE WHEN g.quantity <= w.lvl THEN w.lvl - g.quantity ELSE w.lvl END FROM walk w JOIN good g "
    "ON g.shop_id = w.shop_id AND g.product_id = w.product_id AND g.rn = w.rn + 1), "
    "outcome AS (SELECT g.shop_id, g.id, g.product_id, g.product_name, g.quantity, g.sale_date, "
    "CASE WHEN w.ok THEN 'accepted' ELSE 'rejected' END AS status, "
    "CASE WHEN w.ok THEN '' ELSE 'insufficient_stock' END AS reason, "
    "CASE WHEN w.ok THEN CAST(g.sell_price * g.quantity AS DOUBLE) END AS revenue, "
    "CASE WHEN w.ok THEN CAST((g.sell_price - g.buy_price) * g.quantity AS DOUBLE) END AS profit "
    "FROM good g JOIN walk w ON w.shop_id = g.shop_id AND w.product_id = g.product_id AND w.rn = g.rn "
    "UNION ALL SELECT shop_id, id, product_id, product_name, quantity, sale_date, 'rejected', "
    "concat_ws(';', CASE WHEN coalesce(quantity, 0) <= 0 THEN 'quantity_not_positive' END, "
    "CASE WHEN missing THEN 'product_not_found' END), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM j "
    "WHERE missing OR coalesce(quantity, 0) <= 0)\n"
)


@query(
    "apply_sales",
    with_tables(SALE_FOLD + "SELECT * FROM outcome", "t_sale_commands", "t_products", recursive=True),
)
def apply_sales(t):
    """M4: every lineitem replayed as a sale against the product stock."""
    return L.apply_sales(fx.products(t), fx.sale_commands(t))


@query(
    "apply_sales_stock",
    with_tables(
        SALE_FOLD
        + PRODUCT_D.format(
            src="(SELECT p.shop_id, p.id, p.name, p.category, p.buy_price, p.sell_price, "
            "CAST(p.stock_quantity - coalesce(s.units, 0) AS INTEGER) AS stock_quantity, p.low_stock_threshold "
            "FROM t_products p LEFT JOIN (SELECT shop_id, product_id, sum(quantity) AS units FROM outcome "
            "WHERE status = 'accepted' GROUP BY shop_id, product_id) s ON s.shop_id = p.shop_id "
            "AND s.product_id = p.id) z"
        ),
        "t_sale_commands",
        "t_products",
        recursive=True,
    ),
)
def apply_sales_stock(t):
    """M4: product snapshot after the sales batch."""
    return R.product_list(L.apply_sales_stock(fx.products(t), fx.sale_commands(t)))


@query(
    "validate_sales",
    with_tables(
        "SELECT c.shop_id, c.id, c.product_id, c.quantity, c.command_date, r AS reasons, r = '' AS accepted FROM ("
        "SELECT c.*, concat_ws(';', CASE WHEN coalesce(c.quantity, 0) <= 0 THEN 'quantity_not_positive' END, "
        "CASE WHEN p.id IS NULL THEN 'product_not_found' END) AS r FROM t_sale_commands c LEFT JOIN "
        "(SELECT * FROM t_products p0 WHERE NOT EXISTS (SELECT 1 FROM t_discontinued d WHERE d.shop_id = p0.shop_id "
        "AND d.id = p0.id)) p ON p.shop_id = c.shop_id AND p.id = c.product_id) c",
        "t_sale_commands",
        "t_products",
        "t_discontinued",
    ),
)
def validate_sales(t):
    """V3: sale requests against the products left after the delete batch."""
    products = L.delete_products(fx.products(t), fx.discontinued_products(t))
    return L.validate_sales(products, fx.sale_commands(t))


@query(
    "orphan_sales",
    with_tables(
        "SELECT c.shop_id, c.id, c.product_id, c.quantity, c.command_date FROM t_sale_commands c WHERE NOT EXISTS ("
        "SELECT 1 FROM t_products p WHERE p.shop_id = c.shop_id AND p.id = c.product_id AND NOT EXISTS ("
        "SELECT 1 FROM t_discontinued d WHERE d.shop_id = p.shop_id AND d.id = p.id))",
        "t_sale_commands",
        "t_products",
        "t_discontinued",
    ),
)
def orphan_sales(t):
    """Sale requests whose product no longer exists (anti-join → reject side)."""
    products = L.delete_products(fx.products(t), fx.discontinued_products(t))
    return fx.sale_commands(t).join(
        products.select("shop_id", F.col("id").alias("product_id")), ["shop_id", "product_id"], "left_anti"
    )


# ---------------------------------------------------------------- M6 restocks


V6 = (
    "concat_ws(';', CASE WHEN coalesce(c.quantity, 0) <= 0 THEN 'quantity_not_positive' END, "
    "CASE WHEN " + BLANK.format(c="c.supplier_name") + " THEN 'supplier_required' END, "
    "CASE WHEN coalesce(c.unit_buy_price < 0, true) THEN 'negative_price' END, "
    "CASE WHEN p.id IS NULL THEN 'product_not_found' END)"
)
RESTOCK_V = (
    ", rv AS (SELECT c.*, p.name AS product_name, " + V6 + " AS reasons FROM t_restock_commands c "
    "LEFT JOIN t_products p ON p.shop_id = c.shop_id AND p.id = c.product_id), "
    "rl AS (SELECT shop_id, id, product_id, product_name, quantity AS quantity_added, trim(supplier_name) AS "
    "supplier_name, unit_buy_price, command_date AS restock_date, update_buy_price AS updated_buy_price "
    "FROM rv WHERE reasons = '')\n"
)


@query(
    "validate_restocks",
    with_tables(
        RESTOCK_V + "SELECT shop_id, id, product_id, quantity, supplier_name, reasons, reasons = '' AS accepted FROM rv",
        "t_restock_commands",
        "t_products",
    ),
)
def validate_restocks(t):
    """V6: restock request checks."""
    return L.validate_restocks(fx.products(t), fx.restock_commands(t)).select(
        "shop_id", "id", "product_id", "quantity", "supplier_name", "reasons", "accepted"
    )


@query(
    "apply_restocks",
    with_tables(
        RESTOCK_V + "SELECT shop_id, id, product_id, product_name, quantity_added, supplier_name, "
        "CAST(unit_buy_price AS DOUBLE) AS unit_buy_price, restock_date, updated_buy_price FROM rl",
        "t_restock_commands",
        "t_products",
    ),
)
def apply_restocks(t):
    """M6: restock ledger rows of the accepted requests."""
    from ..operators import history as H

    return H.restock_history(L.apply_restocks(fx.products(t), fx.restock_commands(t)))


@query(
    "apply_restocks_stock",
    with_tables(
        RESTOCK_V
        + PRODUCT_D.format(
            src="(SELECT p.shop_id, p.id, p.name, p.category, coalesce(a.last_price, p.buy_price) AS buy_price, "
            "p.sell_price, CAST(p.stock_quantity + coalesce(a.units, 0) AS INTEGER) AS stock_quantity, "
            "p.low_stock_threshold FROM t_products p LEFT JOIN (SELECT shop_id, product_id, sum(quantity_added) AS units, "
            "arg_max(unit_buy_price, (restock_date, id)) FILTER (WHERE updated_buy_price) AS last_price FROM rl "
            "GROUP BY shop_id, product_id) a ON a.shop_id = p.shop_id AND a.product_id = p.id) z"
        ),
        "t_restock_commands",
        "t_products",
    ),
)
def apply_restocks_stock(t):
    """M6: stock and buy price after the restock batch."""
    return R.product_list(L.apply_restocks_stock(fx.products(t), fx.restock_commands(t)))


# ---------------------------------------------------------------- M9 timeline


TIMELINE = (
    RESTOCK_V
    + ", sv AS (SELECT c.*, p.name AS product_name, p.id IS NULL AS missing FROM t_sale_commands c LEFT JOIN t_products p "
    "ON p.shop_id = c.shop_id AND p.id = c.product_id), "
    "cmd AS (SELECT shop_id, product_id, id, restock_date AS d, 0 AS rk, 0 AS kind, quantity_added AS q, "
    "CASE WHEN updated_buy_price THEN CAST(unit_buy_price * 100 AS BIGINT) END AS mark FROM rl UNION ALL "
    "SELECT shop_id, product_id, id, command_date, 1, 1, quantity, NULL FROM sv WHERE NOT missing AND "
    "coalesce(quantity, 0) > 0), "
    "seqd AS (SELECT c.*, p.stock_quantity AS open_lvl, CAST(p.buy_price * 100 AS BIGINT) AS open_mark, "
    "p.sell_price, p.name AS product_name, row_number() OVER (PARTITION BY c.shop_id, c.product_id ORDER BY d, c.id, rk) AS rn "
    "FROM cmd c JOIN t_products p ON p.shop_id = c.shop_id AND p.id = c.product_id), "
    "walk AS (SELECT shop_id, product_id, rn, kind = 0 OR q <= open_lvl AS ok, "
    "CASE WHEN kind = 0 THEN open_lvl + q WHEN q <= open_lvl THEN open_lvl - q ELSE open_lvl END AS lvl, "
    "coalesce(mark, open_mark) AS mk FROM seqd WHERE rn = 1 UNION ALL "
    "SELECT s.shop_id, s.product_id, s.rn, s.kind = 0 OR s.q <= w.lvl, "
    "CASE WHEN s.kind = 0 THEN w.lvl + s.q WHEN s.q <= w.lvl THEN w.lvl - s.q ELSE w.lvl END, "
    "coalesce(s.mark, w.mk) FROM walk w JOIN seqd s ON s.shop_id = w.shop_id AND s.product_id = w.product_id "
    "AND s.rn = w.rn + 1)\n"
)


@query(
    "apply_stock_timeline",
    with_tables(
        TIMELINE
        + "SELECT s.shop_id, s.id, s.product_id, s.product_name, s.q AS quantity, s.d AS sale_date, "
        "CASE WHEN w.ok THEN 'accepted' ELSE 'rejected' END AS status, "
        "CASE WHEN w.ok THEN '' ELSE 'insufficient_stock' END AS reason, "
        "CASE WHEN w.ok THEN CAST(s.sell_price * s.q AS DOUBLE) END AS revenue, "
        "CASE WHEN w.ok THEN CAST((s.sell_price - CAST(w.mk AS DECIMAL(18,0)) * 0.01) * s.q AS DOUBLE) END AS profit "
        "FROM seqd s JOIN walk w ON w.shop_id = s.shop_id AND w.product_id = s.product_id AND w.rn = s.rn "
        "WHERE s.kind = 1 UNION ALL SELECT shop_id, id, product_id, product_name, quantity, command_date, 'rejected', "
        "concat_ws(';', CASE WHEN coalesce(quantity, 0) <= 0 THEN 'quantity_not_positive' END, "
        "CASE WHEN missing THEN 'product_not_found' END), NULL, NULL FROM sv WHERE missing OR coalesce(quantity, 0) <= 0",
        "t_restock_commands",
        "t_sale_commands",
        "t_products",
        recursive=True,
    ),
)
def apply_stock_timeline(t):
    """M9: sales and restocks interleaved; each sale sees the stock and buy price of its moment."""
    return L.apply_stock_timeline(fx.products(t), fx.sale_commands(t), fx.restock_commands(t))


@query(
    "timeline_stock",
    with_tables(
        TIMELINE
        + PRODUCT_D.format(
            src="(SELECT p.shop_id, p.id, p.name, p.category, CASE WHEN e.mk IS NULL THEN p.buy_price ELSE "
            "CAST(CAST(e.mk AS DECIMAL(18,0)) * 0.01 AS DECIMAL(12,2)) END AS buy_price, p.sell_price, "
            "CAST(coalesce(e.lvl, p.stock_quantity) AS INTEGER) AS stock_quantity, p.low_stock_threshold FROM t_products p "
            "LEFT JOIN (SELECT shop_id, product_id, arg_max(lvl, rn) AS lvl, arg_max(mk, rn) AS mk FROM walk "
            "GROUP BY shop_id, product_id) e ON e.shop_id = p.shop_id AND e.product_id = p.id) z"
        ),
        "t_restock_commands",
        "t_sale_commands",
        "t_products",
        recursive=True,
    ),
)
def timeline_stock(t):
    """M9: stock and buy price after the timeline."""
    return R.product_list(L.timeline_stock(fx.products(t), fx.sale_commands(t), fx.restock_commands(t)))


# ---------------------------------------------------------------- M5, M7, M8 customers and shops


V4 = (
    "concat_ws(';', CASE WHEN " + BLANK.format(c="customer_name") + " THEN 'name_required' END, "
    "CASE WHEN coalesce(CAST(amount AS DECIMAL(12,2)), 0) <= 0 THEN 'amount_not_positive' END)"
)
UPSERT = (
    f", va AS (SELECT *, {V4} AS reasons, lower(trim(customer_name)) AS nk FROM t_debt_commands), "
    "v AS (SELECT * FROM va WHERE reasons = ''), "
    "per_name AS (SELECT shop_id, nk, arg_min(trim(customer_name), seq) AS first_name, min(seq) AS first_seq, "
    "arg_max(trim(phone), seq) FILTER (WHERE phone IS NOT NULL AND trim(phone) <> '') AS ph FROM v "
    "GROUP BY shop_id, nk), "
    "keys AS (SELECT shop_id, lower(trim(name)) AS nk, min(id) AS cid FROM t_customers GROUP BY shop_id, lower(trim(name))), "
    "newc AS (SELECT n.shop_id, (SELECT coalesce(max(id), 0) FROM t_customers) + row_number() OVER (ORDER BY n.first_seq) AS id, "
    "n.first_name AS name, n.ph AS phone FROM per_name n LEFT JOIN keys k "
    "ON k.shop_id = n.shop_id AND k.nk = n.nk WHERE k.cid IS NULL), "
    "oldc AS (SELECT c.shop_id, c.id, c.name, coalesce(u.ph, c.phone) AS phone FROM t_customers c LEFT JOIN "
    "(SELECT k.shop_id, k.cid, n.ph FROM per_name n JOIN keys k ON k.shop_id = n.shop_id AND k.nk = n.nk "
    "WHERE n.ph IS NOT NULL) u ON u.shop_id = c.shop_id AND u.cid = c.id), "
    "after AS (SELECT * FROM oldc UNION ALL SELECT * FROM newc)\n"
)


@query("upsert_customers", with_tables(UPSERT + "SELECT * FROM after", "t_debt_commands", "t_customers"))
def upsert_customers(t):
    """M5: customers after a debt batch (case-insensitive name match, phone overwrite)."""
    return L.upsert_customers(fx.customers(t), fx.debt_commands(t))


@query(
    "apply_debts",
    with_tables(
        UPSERT
        + "SELECT a.shop_id, a.seq AS id, CASE WHEN a.reasons = '' THEN k.cid END AS customer_id, "
        "trim(a.customer_name) AS customer_name, 'debt' AS transaction_type, "
        "CAST(CAST(a.amount AS DECIMAL(12,2)) AS DOUBLE) AS amount, nullif(trim(a.note), '') AS note, "
        "a.command_date AS transaction_date, CASE WHEN a.reasons = '' THEN 'accepted' ELSE 'rejected' END AS status, "
        "a.reasons AS reason FROM va a LEFT JOIN (SELECT shop_id, lower(trim(name)) AS nk, min(id) AS cid FROM after "
        "GROUP BY shop_id, lower(trim(name))) k ON k.shop_id = a.shop_id AND k.nk = a.nk",
        "t_debt_commands",
        "t_customers",
    ),
)
def apply_debts(t):
    """M5: debt ledger rows with resolved customer ids."""
    return L.apply_debts(fx.customers(t), fx.debt_commands(t))


@query(
    "validate_debts",
    with_tables(
        f"SELECT shop_id, seq, customer_name, {V4} AS reasons, {V4} = '' AS accepted FROM t_debt_commands",
        "t_debt_commands",
    ),
)
def validate_debts(t):
    """V4/V9: debt requests (amounts that round to 0.00 are rejected)."""
    return L.validate_debts(fx.debt_commands(t)).select("shop_id", "seq", "customer_name", "reasons", "accepted")


PAY = (
    ", pv AS (SELECT d.*, c.name AS c_name, concat_ws(';', "
    "CASE WHEN coalesce(d.transaction_type NOT IN ('debt', 'payment'), true) THEN 'unknown_type' END, "
    "CASE WHEN coalesce(CAST(d.amount AS DECIMAL(12,2)), 0) <= 0 THEN 'amount_not_positive' END, "
    "CASE WHEN c.id IS NULL THEN 'customer_not_found' END) AS reasons FROM t_credit_commands d LEFT JOIN "
    "(SELECT * FROM t_customers c0 WHERE NOT EXISTS (SELECT 1 FROM t_customer_deletes x WHERE x.shop_id = c0.shop_id "
    "AND x.id = c0.id)) c ON c.shop_id = d.shop_id AND c.id = d.customer_id), "
    "pl AS (SELECT *, CASE WHEN transaction_type = 'payment' THEN c_name ELSE coalesce(trim(customer_name), c_name) END "
    "AS row_name, CASE WHEN transaction_type = 'payment' THEN 'Customer payment' ELSE nullif(trim(note), '') END AS row_note, "
    "CAST(amount AS DECIMAL(12,2)) AS rounded FROM pv), "
    "pg AS (SELECT *, transaction_type = 'payment' AS take, "
    "row_number() OVER (PARTITION BY shop_id, customer_id ORDER BY transaction_date, id) AS rn FROM pl "
    "WHERE reasons = ''), "
    "walk AS (SELECT shop_id, customer_id, CAST(0 AS BIGINT) AS rn, true AS ok, CAST(0 AS DECIMAL(18,2)) AS lvl FROM pg "
    "GROUP BY shop_id, customer_id UNION ALL SELECT g.shop_id, g.customer_id, g.rn, NOT g.take OR g.amount <= w.lvl, "
    "CAST(CASE WHEN NOT g.take THEN w.lvl + g.rounded WHEN g.amount <= w.lvl THEN w.lvl - g.rounded ELSE w.lvl END "
    "AS DECIMAL(18,2)) FROM walk w JOIN pg g ON g.shop_id = w.shop_id AND g.customer_id = w.customer_id "
    "AND g.rn = w.rn + 1)\n"
)
PAY_ROW = (
    "SELECT {a}shop_id, {a}id, {a}customer_id, {a}row_name AS customer_name, {a}transaction_type, "
    "CAST({a}rounded AS DOUBLE) AS amount, {a}row_note AS note, {a}transaction_date, "
)


@query(
    "apply_payments",
    with_tables(
        PAY
        + PAY_ROW.format(a="g.")
        + "CASE WHEN w.ok THEN 'accepted' ELSE 'rejected' END AS status, "
        "CASE WHEN w.ok THEN '' ELSE 'exceeds_balance' END AS reason FROM pg g JOIN walk w "
        "ON w.shop_id = g.shop_id AND w.customer_id = g.customer_id AND w.rn = g.rn UNION ALL "
        + PAY_ROW.format(a="")
        + "'rejected', reasons FROM pl WHERE reasons <> ''",
        "t_credit_commands",
        "t_customers",
        "t_customer_deletes",
        recursive=True,
    ),
)
def apply_payments(t):
    """M7: the credit commands replayed with the overpayment guard (customers of one
    segment deleted first, so their rows are rejected as unknown)."""
    customers = fx.customers(t).join(fx.customer_deletes(t), ["shop_id", "id"], "left_anti")
    return L.apply_payments(customers, fx.credit_commands(t))


@query(
    "validate_payments",
    with_tables(
        PAY + "SELECT shop_id, id, customer_id, reasons, reasons = '' AS accepted FROM pv",
        "t_credit_commands",
        "t_customers",
        "t_customer_deletes",
        recursive=True,
    ),
)
def validate_payments(t):
    """V4/V5: known type, amount > 0 and customer exists."""
    customers = fx.customers(t).join(fx.customer_deletes(t), ["shop_id", "id"], "left_anti")
    return L.validate_payments(customers, fx.credit_commands(t)).select(
        "shop_id", "id", "customer_id", "reasons", "accepted"
    )


@query(
    "onboard_shops",
    with_tables(
        ", c AS (SELECT r.*, concat_ws(';', CASE WHEN " + BLANK.format(c="r.shop_name") + " THEN 'blank_shop_name' END, "
        "CASE WHEN p.id IS NOT NULL THEN 'already_has_shop' END) AS reasons FROM t_onboarding r "
        "LEFT JOIN t_profiles p ON p.id = r.user_id), "
        "f AS (SELECT user_id, min(seq) AS first FROM c WHERE reasons = '' GROUP BY user_id), "
        "o AS (SELECT c.*, CASE WHEN c.reasons <> '' THEN c.reasons WHEN c.seq <> f.first THEN 'already_has_shop' "
        "ELSE '' END AS reason FROM c LEFT JOIN f ON f.user_id = c.user_id)\n"
        "SELECT user_id, seq, CASE WHEN reason = '' THEN 'accepted' ELSE 'rejected' END AS status, reason, "
        "CASE WHEN reason = '' THEN (SELECT coalesce(max(id), 0) FROM t_shops) + row_number() OVER (PARTITION BY reason = '' "
        "ORDER BY seq) END AS shop_id, CASE WHEN reason = '' THEN trim(shop_name) END AS shop_name, "
        "CASE WHEN reason = '' THEN nullif(trim(full_name), '') END AS full_name, "
        "CASE WHEN reason = '' THEN 'owner' END AS role FROM o",
        "t_onboarding",
        "t_profiles",
        "t_shops",
    ),
)
def onboard_shops(t):
    """M8: shop + owner-profile creation for each sign-up request."""
    return L.onboard_shops(fx.shops(t), fx.profiles(t), fx.onboarding_requests(t))
