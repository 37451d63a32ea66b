"""DuckDB twins of ``sources/fixtures.py`` (formula for formula).

``with_tables(body, "sales", …)`` prefixes ``body`` with the CTEs it needs (and
their dependencies) so each oracle statement is self-contained over the
driver's pre-registered views.
"""

from __future__ import annotations

import re

from ..functions.expr import WHITE_SPACE
from ..sources.fixtures import (
    BUY_RATIO,
    DISCONTINUED_BRAND,
    PROFIT_RATIO,
    QUESTION_PHRASES,
    RESTOCK_PRICE_RATIO,
    SHOP_COUNT,
    TODAY,
    CLOSED_SEGMENT,
    DEMO_DAYS,
)

T = f"DATE '{TODAY.isoformat()}'"
MONEY = "DECIMAL(12,2)"

LINE_ID = (
    "concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), "
    "CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y%m%d'), CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), "
    f"CAST(CAST(CAST(l_extendedprice AS {MONEY}) * 100 AS BIGINT) AS VARCHAR))"
)
PNAME = "p_name || ' ' || CAST(p_partkey AS VARCHAR)"

_phrases = ", ".join(f"({i}, '" + q.replace("'", "''") + "')" for i, q in enumerate(QUESTION_PHRASES))

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "t_shops": (
        "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS owner_id FROM nation",
        (),
    ),
    "t_profiles": (
        "SELECT CAST(f.n_regionkey AS BIGINT) AS id, CAST(f.shop_id AS BIGINT) AS shop_id, r.r_name AS full_name, "
        "'owner' AS role FROM (SELECT n_regionkey, min(n_nationkey) AS shop_id FROM nation GROUP BY n_regionkey) f "
        "LEFT JOIN region r ON f.n_regionkey = r.r_regionkey",
        (),
    ),
    "t_products": (
        f"SELECT p_partkey % {SHOP_COUNT} AS shop_id, p_partkey AS id, {PNAME} AS name, p_type AS category, "
        f"CAST(CAST(p_retailprice AS {MONEY}) * {BUY_RATIO} AS {MONEY}) AS buy_price, "
        f"CAST(p_retailprice AS {MONEY}) AS sell_price, "
        "CAST((p_partkey * 37 + p_size) % 120 AS INTEGER) AS stock_quantity, p_size AS low_stock_threshold FROM part",
        (),
    ),
    "t_sales0": (
        f"SELECT l_partkey % {SHOP_COUNT} AS shop_id, {LINE_ID} AS id, l_partkey AS product_id, {PNAME} AS product_name, "
        "CAST(l_quantity AS INTEGER) AS quantity, CAST(l_shipdate AS DATE) AS sale_date, "
        f"CAST(CAST(l_extendedprice AS {MONEY}) * (1 - CAST(l_discount AS {MONEY})) AS {MONEY}) AS revenue "
        "FROM lineitem JOIN part ON l_partkey = p_partkey",
        (),
    ),
    "t_sales": (
        f"SELECT *, CAST(revenue * {PROFIT_RATIO} AS {MONEY}) AS profit FROM t_sales0",
        ("t_sales0",),
    ),
    "t_sales_text": (
        "SELECT shop_id, id, product_id, product_name, quantity, "
        "CASE WHEN CAST(split_part(id, '-', 1) AS BIGINT) % 23 = 0 THEN 'bad' "
        "WHEN CAST(split_part(id, '-', 1) AS BIGINT) % 29 = 0 THEN strftime(sale_date, '%m/%d/%Y') "
        "ELSE strftime(sale_date, '%Y-%m-%d') END AS sale_date, revenue, profit FROM t_sales",
        ("t_sales",),
    ),
    "t_customers": (
        "SELECT CAST(c_nationkey AS BIGINT) AS shop_id, c_custkey AS id, c_name AS name, "
        "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '06' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS phone "
        "FROM customer",
        (),
    ),
    "t_debts": (
        "SELECT CAST(c_nationkey AS BIGINT) AS shop_id, o_orderkey AS id, o_custkey AS customer_id, "
        "c_name AS customer_name, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'debt' ELSE 'payment' END "
        f"AS transaction_type, CAST(o_totalprice AS {MONEY}) AS amount, o_orderpriority AS note, "
        "CAST(o_orderdate AS DATE) AS transaction_date FROM orders JOIN customer ON o_custkey = c_custkey",
        (),
    ),
    "t_restocks": (
        f"SELECT l_partkey % {SHOP_COUNT} AS shop_id, {LINE_ID} AS id, l_partkey AS product_id, {PNAME} AS product_name, "
        "CAST(l_quantity AS INTEGER) AS quantity_added, s_name AS supplier_name, "
        f"CAST(CAST(l_extendedprice AS {MONEY}) * {RESTOCK_PRICE_RATIO} AS {MONEY}) AS unit_buy_price, "
        "CAST(l_shipdate AS DATE) AS restock_date, l_linestatus = 'O' AS updated_buy_price "
        "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
        (),
    ),
    "t_discontinued": (
        f"SELECT p_partkey % {SHOP_COUNT} AS shop_id, p_partkey AS id FROM part WHERE p_brand = '{DISCONTINUED_BRAND}' "
        f"UNION ALL SELECT p_partkey % {SHOP_COUNT} AS shop_id, p_partkey + 1000000000 AS id FROM part "
        f"WHERE p_brand = '{DISCONTINUED_BRAND}'",
        (),
    ),
    "t_product_requests": (
        f"SELECT p_partkey % {SHOP_COUNT} AS shop_id, p_partkey AS seq, "
        f"CASE WHEN p_partkey % 34 = 0 THEN '\t\u00a0' WHEN p_partkey % 17 = 0 THEN '  ' WHEN p_partkey % 11 = 0 THEN upper({PNAME}) "
        "WHEN p_partkey % 13 = 0 THEN p_brand || ' special' "
        "ELSE ' ' || p_name || ' new ' || CAST(p_partkey AS VARCHAR) END AS name, "
        "CASE WHEN p_partkey % 23 = 0 THEN '' ELSE p_type END AS category, "
        f"CAST(CASE WHEN p_partkey % 19 = 0 THEN -1.00 WHEN p_partkey % 41 <> 0 THEN CAST(CAST(p_retailprice AS {MONEY}) * {BUY_RATIO} AS {MONEY}) END AS {MONEY}) AS buy_price, "
        f"CAST(CASE WHEN p_partkey % 29 = 0 THEN -1.00 ELSE CAST(p_retailprice AS {MONEY}) END AS {MONEY}) AS sell_price, "
        "CAST(CASE WHEN p_partkey % 31 = 0 THEN -1 WHEN p_partkey % 43 <> 0 THEN p_size END AS INTEGER) AS stock_quantity, "
        "CAST(CASE WHEN p_partkey % 37 = 0 THEN -1 ELSE 5 END AS INTEGER) AS low_stock_threshold FROM part",
        (),
    ),
    "t_product_updates": (
        f"SELECT l_partkey % {SHOP_COUNT} AS shop_id, "
        "CASE WHEN l_orderkey % 9 = 0 THEN l_partkey + 1000000000 ELSE l_partkey END AS id, "
        f"CAST(l_shipdate AS DATE) AS command_date, {LINE_ID} AS command_id, "
        "CASE WHEN l_orderkey % 10 = 3 THEN 'Shared ' || CAST(l_partkey % 5 AS VARCHAR) "
        f"WHEN l_orderkey % 10 = 4 THEN upper({PNAME}) "
        f"WHEN l_orderkey % 10 = 5 THEN '\tpool ' || CAST(l_orderkey % 7 AS VARCHAR) ELSE {PNAME} END AS name, "
        "p_type AS category, CASE WHEN l_orderkey % 13 <> 0 THEN "
        f"CAST(CAST(l_extendedprice AS {MONEY}) * 0.015 AS {MONEY}) END AS buy_price, "
        f"CAST(CAST(l_extendedprice AS {MONEY}) * 0.02 AS {MONEY}) AS sell_price, "
        "CAST(l_quantity AS INTEGER) AS stock_quantity, l_linenumber AS low_stock_threshold "
        "FROM lineitem JOIN part ON l_partkey = p_partkey",
        (),
    ),
    "t_sale_commands": (
        f"SELECT l_partkey % {SHOP_COUNT} AS shop_id, l_partkey AS product_id, {LINE_ID} AS id, "
        "CAST(l_shipdate AS DATE) AS command_date, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem",
        (),
    ),
    "t_restock_commands": (
        f"SELECT l_partkey % {SHOP_COUNT} AS shop_id, l_partkey AS product_id, {LINE_ID} AS id, "
        "CAST(l_shipdate AS DATE) AS command_date, "
        "CASE WHEN l_orderkey % 41 = 0 THEN 0 WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INTEGER) "
        "ELSE CAST(floor(l_quantity / 10) AS INTEGER) END AS quantity, "
        "CASE WHEN l_orderkey % 43 = 0 THEN ' \n' ELSE s_name END AS supplier_name, CASE WHEN l_orderkey % 53 <> 0 THEN "
        f"CAST(CAST(l_extendedprice AS {MONEY}) * {RESTOCK_PRICE_RATIO} AS {MONEY}) END AS unit_buy_price, "
        "l_linestatus = 'O' AS update_buy_price "
        "FROM lineitem JOIN supplier ON l_suppkey = s_suppkey",
        (),
    ),
    "t_debt_commands": (
        "SELECT CAST(c_nationkey AS BIGINT) AS shop_id, o_orderkey AS seq, "
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'Guest ' || CAST(o_custkey % 7 AS VARCHAR) "
        "WHEN o_orderkey % 3 = 0 THEN lower(c_name) WHEN o_orderkey % 3 = 1 THEN upper(c_name) "
        "ELSE ' ' || c_name || ' ' END AS customer_name, "
        "CASE WHEN o_orderpriority = '1-URGENT' THEN '07' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') "
        "ELSE ' ' END AS phone, "
        "CAST(CASE WHEN o_orderkey % 47 = 0 THEN 0.004 ELSE o_totalprice END AS DOUBLE) AS amount, "
        "o_orderpriority AS note, CAST(o_orderdate AS DATE) AS command_date "
        "FROM orders JOIN customer ON o_custkey = c_custkey",
        (),
    ),
    "t_credit_commands": (
        "SELECT shop_id, id, customer_id, customer_name, CASE WHEN id % 59 = 0 THEN 'refund' WHEN id % 61 <> 0 "
        "THEN transaction_type END AS transaction_type, CAST(CASE WHEN id % 67 = 0 THEN 0.004 "
        "ELSE CAST(amount AS DECIMAL(14,3)) + CASE WHEN id % 3 = 0 THEN 0.004 ELSE 0.000 END END AS DECIMAL(14,3)) AS amount, "
        "note, transaction_date FROM t_debts",
        ("t_debts",),
    ),
    "t_profile_requests": (
        "SELECT CAST(n_nationkey AS BIGINT) AS request_id, CAST(n_regionkey AS BIGINT) AS caller_id, "
        "CAST(CASE WHEN n_nationkey % 4 = 3 THEN (n_regionkey + 1) % 5 WHEN n_nationkey % 11 <> 10 THEN n_regionkey END "
        "AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS shop_id, "
        "CASE WHEN n_nationkey % 6 = 5 THEN 'staff' WHEN n_nationkey % 7 <> 6 THEN 'owner' END AS role "
        "FROM nation",
        (),
    ),
    "t_tenant_requests": (
        "SELECT s.id AS request_id, sh.owner_id + CASE WHEN s.quantity % 4 = 1 THEN 1000000 ELSE 0 END AS caller_id, "
        "CASE WHEN s.quantity IN (13, 14) THEN NULL ELSE s.shop_id END AS requested_shop_id "
        "FROM t_sales s JOIN t_shops sh ON s.shop_id = sh.id",
        ("t_sales", "t_shops"),
    ),
    "t_onboarding": (
        "SELECT s_suppkey + 100 AS user_id, CASE WHEN s_suppkey % 9 = 0 THEN '   ' ELSE s_name || ' shop' END AS shop_name, "
        "' ' || s_name || ' ' AS full_name, s_suppkey + 100 AS seq FROM supplier "
        "UNION ALL SELECT CAST(r_regionkey AS BIGINT) AS user_id, r_name || ' second shop' AS shop_name, "
        "r_name AS full_name, CAST(r_regionkey AS BIGINT) AS seq FROM region",
        (),
    ),
    "t_questions": (
        "SELECT s.id * 1000 + CAST(p.i AS BIGINT) AS question_id, s.id AS shop_id, p.q AS question "
        f"FROM t_shops s CROSS JOIN (VALUES {_phrases}) p(i, q) "
        "UNION ALL SELECT 1000000000 + conv_id * 1000 + turn AS question_id, "
        f"conv_id % {SHOP_COUNT} AS shop_id, text AS question FROM conversations",
        ("t_shops",),
    ),
    "t_product_text": (
        "SELECT shop_id, seq, name, CASE WHEN seq % 7 = 0 THEN 'n/a' ELSE CAST(buy_price AS VARCHAR) END AS buy_price, "
        "CASE WHEN seq % 5 = 0 THEN '' ELSE CAST(sell_price AS VARCHAR) END AS sell_price, "
        "CASE WHEN seq % 9 = 0 THEN '12.7' WHEN seq % 9 = 3 THEN '1e1' WHEN seq % 3 = 0 THEN ' 12\t' ELSE CAST(stock_quantity AS VARCHAR) END AS stock_quantity, "
        "CASE WHEN seq % 8 = 0 THEN 'x' ELSE CAST(low_stock_threshold AS VARCHAR) END AS low_stock_threshold "
        "FROM t_product_requests",
        ("t_product_requests",),
    ),
    "t_daily_ranges": (
        f"SELECT p_partkey % {SHOP_COUNT} AS shop_id, p_partkey AS product_id, CAST(p_size % 4 AS INTEGER) AS min_units, "
        "CAST(p_size % 4 + p_partkey % 9 AS INTEGER) AS max_units FROM part",
        (),
    ),
    "t_demo_debts": (
        "SELECT CAST(c_nationkey AS BIGINT) AS shop_id, o_orderkey AS id, c_name AS customer_name, "
        "CASE WHEN o_orderstatus IN ('F', 'P') THEN 'debt' ELSE 'payment' END AS transaction_type, "
        f"CAST(o_totalprice AS {MONEY}) AS amount, o_orderpriority AS note, "
        f"CAST(o_orderkey % {DEMO_DAYS} AS INTEGER) AS days_ago FROM orders JOIN customer ON o_custkey = c_custkey",
        (),
    ),
    "t_customer_deletes": (
        f"SELECT CAST(c_nationkey AS BIGINT) AS shop_id, c_custkey AS id FROM customer WHERE c_mktsegment = '{CLOSED_SEGMENT}'",
        (),
    ),
}


def python_strip(sql: str) -> str:
    """``trim(x)`` of a statement as Python's ``strip``, which removes all white space."""
    return re.sub(r"\btrim\(([\w.]+)\)", lambda m: f"trim({m[1]}, '{WHITE_SPACE}')", sql)


def with_tables(body: str, *names: str, recursive: bool = False) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = python_strip(body)
    if not order:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order) + "\n" + body
