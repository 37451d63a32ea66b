"""Text-answer queries (Q1-Q8) over the driver tables."""

from __future__ import annotations

from ..operators import answers as A
from ..sources import fixtures as fx
from .oracle_tables import T, with_tables
from .q_reports import BAL, RECO_BODY, TODAY, WEEK_SRC, _ranking_sql
from .registry import query

MONEY_TEXT = "format('{{:,.2f}}', CAST({x} AS DOUBLE)) || ' MAD'"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


INTENT_SQL = (
    "CASE WHEN contains(q, 'restock') THEN 'restock' "
    "WHEN contains(q, 'best') AND contains(q, 'product') THEN 'best_products' "
    "WHEN contains(q, 'profit') AND contains(q, 'week') THEN 'profit_week' "
    "WHEN contains(q, 'profit') AND (contains(q, 'today') OR contains(q, 'daily')) THEN 'profit_today' "
    "WHEN contains(q, 'who') AND (contains(q, 'owe') OR contains(q, 'debt')) THEN 'debtors' "
    "WHEN contains(q, 'unpaid') OR (contains(q, 'total') AND contains(q, 'debt')) THEN 'unpaid' "
    "WHEN contains(q, 'low') AND contains(q, 'stock') THEN 'low_stock' ELSE 'help' END"
)
INTENTS = (
    f"SELECT question_id, shop_id, question, {INTENT_SQL} AS intent "
    "FROM (SELECT *, lower(trim(question)) AS q FROM t_questions) x"
)


def _sentence(lists: str, intent: str, prefix: str, empty: str) -> str:
    return (
        f"SELECT s.id AS shop_id, '{intent}' AS intent, CASE WHEN l.text IS NULL THEN {_q(empty)} "
        f"ELSE {_q(prefix)} || l.text || '.' END AS answer FROM t_shops s LEFT JOIN ({lists}) l ON l.shop_id = s.id"
    )


RESTOCK_BODY = _sentence(
    "SELECT shop_id, string_agg(name || ' (' || CAST(stock_quantity AS VARCHAR) || ' left: ' || "
    "recommendation_reason || ')', '; ' ORDER BY pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY "
    "shop_id ORDER BY estimated_days_until_stockout ASC NULLS LAST, stock_quantity, name) AS pos "
    f"FROM ({RECO_BODY}) r) x WHERE pos <= {A.RESTOCK_ITEMS} GROUP BY shop_id",
    A.RESTOCK, A.RESTOCK_PREFIX, A.RESTOCK_EMPTY,
)
BEST_BODY = _sentence(
    "SELECT shop_id, string_agg(product_name || ' (' || CAST(units_sold AS VARCHAR) || ' units)', '; ' "
    f"ORDER BY rank) AS text FROM ({_ranking_sql('t_sales', 'units_sold', A.BEST_ITEMS)}) r GROUP BY shop_id",
    A.BEST, A.BEST_PREFIX, A.BEST_EMPTY,
)
PROFIT_BODY = (
    f"SELECT s.id AS shop_id, '{A.PROFIT_WEEK}' AS intent, {_q(A.PROFIT_WEEK_PREFIX)} || "
    + MONEY_TEXT.format(x="coalesce(w.p, 0)")
    + f" || '.' AS answer FROM t_shops s LEFT JOIN (SELECT shop_id, sum(profit) AS p FROM {WEEK_SRC} w0 "
    "GROUP BY shop_id) w ON w.shop_id = s.id UNION ALL "
    f"SELECT s.id, '{A.PROFIT_TODAY}', {_q(A.PROFIT_TODAY_PREFIX)} || "
    + MONEY_TEXT.format(x="coalesce(d.p, 0)")
    + f" || '.' FROM t_shops s LEFT JOIN (SELECT shop_id, sum(profit) AS p FROM t_sales WHERE sale_date = {T} "
    "GROUP BY shop_id) d ON d.shop_id = s.id"
)
DEBTORS_BODY = _sentence(
    "SELECT shop_id, string_agg(customer_name || ' (' || "
    + MONEY_TEXT.format(x="remaining_balance")
    + " || ')', '; ' ORDER BY pos) AS text FROM (SELECT *, row_number() OVER (PARTITION BY shop_id ORDER BY "
    f"remaining_balance DESC, lower(customer_name), customer_name) AS pos FROM ({BAL}) b "
    f"WHERE remaining_balance > 0) x WHERE pos <= {A.DEBTOR_ITEMS} GROUP BY shop_id",
    A.DEBTORS, A.DEBTORS_PREFIX, A.DEBTORS_EMPTY,
)
UNPAID_BODY = (
    f"SELECT s.id AS shop_id, '{A.UNPAID}' AS intent, {_q(A.UNPAID_PREFIX)} || "
    + MONEY_TEXT.format(x="coalesce(u.total, 0)")
    + " || '.' AS answer FROM t_shops s LEFT JOIN (SELECT shop_id, sum(greatest(remaining_balance, 0)) AS total "
    f"FROM ({BAL}) b GROUP BY shop_id) u ON u.shop_id = s.id"
)
LOW_BODY = (
    f"SELECT s.id AS shop_id, '{A.LOW_STOCK}' AS intent, CAST(coalesce(l.part, 0) AS INTEGER) AS part, "
    f"CASE WHEN l.text IS NULL THEN {_q(A.LOW_STOCK_EMPTY)} ELSE {_q(A.LOW_STOCK_PREFIX)} || l.text || '.' END AS answer "
    "FROM t_shops s LEFT JOIN (SELECT shop_id, part, string_agg(name || ' (' || CAST(stock_quantity AS VARCHAR) || "
    "' left)', '; ' ORDER BY stock_quantity, name) AS text FROM (SELECT *, (row_number() OVER (PARTITION BY shop_id "
    f"ORDER BY stock_quantity, name) - 1) // {A.PART_ITEMS} AS part FROM t_products "
    "WHERE stock_quantity <= low_stock_threshold) p GROUP BY shop_id, part) l ON l.shop_id = s.id"
)
ALL_ANSWERS = " UNION ALL ".join(
    f"SELECT shop_id, intent, {'part' if b is LOW_BODY else '0 AS part'}, answer FROM ({b}) a{i}"
    for i, b in enumerate([RESTOCK_BODY, BEST_BODY, PROFIT_BODY, DEBTORS_BODY, UNPAID_BODY, LOW_BODY])
)


def _answers(t):
    return A.answer_table(fx.shops(t), fx.products(t), fx.sales(t), fx.customers(t), fx.debts(t), TODAY)


@query("question_intent", with_tables(INTENTS, "t_questions"))
def question_intent(t):
    """Q1: intent of every question (fixed phrases per shop and every user turn)."""
    return A.question_intent(fx.questions(t))


@query("answer_restock", with_tables(RESTOCK_BODY, "t_shops", "t_products", "t_sales"))
def answer_restock(t):
    """Q2: the restock answer of every shop."""
    return A.answer_restock(fx.shops(t), fx.products(t), fx.sales(t), TODAY)


@query("answer_best", with_tables(BEST_BODY, "t_shops", "t_sales"))
def answer_best(t):
    """Q3: the best-seller answer of every shop."""
    return A.answer_best(fx.shops(t), fx.sales(t))


@query("answer_profit", with_tables(PROFIT_BODY, "t_shops", "t_sales"))
def answer_profit(t):
    """Q4: weekly and daily profit answers of every shop."""
    return A.answer_profit(fx.shops(t), fx.products(t), fx.sales(t), TODAY)


@query("answer_debtors", with_tables(DEBTORS_BODY, "t_shops", "t_customers", "t_debts"))
def answer_debtors(t):
    """Q5: the debtor answer of every shop."""
    return A.answer_debtors(fx.shops(t), fx.customers(t), fx.debts(t))


@query("answer_unpaid", with_tables(UNPAID_BODY, "t_shops", "t_customers", "t_debts"))
def answer_unpaid(t):
    """Q6: the total-unpaid answer of every shop."""
    return A.answer_unpaid(fx.shops(t), fx.customers(t), fx.debts(t))


@query("answer_low_stock", with_tables(LOW_BODY, "t_shops", "t_products"))
def answer_low_stock(t):
    """Q7: the low-stock answer of every shop (every low-stock product listed)."""
    return A.answer_low_stock(fx.shops(t), fx.products(t))


@query(
    "assistant_answers",
    with_tables(
        f"SELECT i.question_id, i.shop_id, i.question, i.intent, "
        f"CAST(coalesce(a.part, 0) AS INTEGER) AS part, coalesce(a.answer, {_q(A.HELP_TEXT)}) AS answer "
        f"FROM ({INTENTS}) i LEFT JOIN ({ALL_ANSWERS}) a ON a.shop_id = i.shop_id AND a.intent = i.intent",
        "t_questions",
        "t_shops",
        "t_products",
        "t_sales",
        "t_customers",
        "t_debts",
    ),
)
def assistant_answers(t):
    """Q8: every question answered (help text when no rule matches)."""
    return A.assistant_answers(fx.questions(t), _answers(t))
