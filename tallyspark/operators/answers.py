"""Rule-based text answers over the reports (Q1-Q8), for every shop at once.

Each question gets an intent from ordered substring rules.  Answers are
computed once per ``(shop_id, intent)`` from the report plans and joined back
to the questions on that key, so the report work does not grow with the
number of questions.  The answer table holds at most one row per shop and
intent; AQE broadcasts it when its measured size is small and otherwise
sort-merge joins it (skew-join splitting covers a shop with a third of all
questions).

Item lists are ordered like the reference's tables and then joined with
``"; "``; the restock, best-seller and debtor lists keep the first 8 / 5 / 8
items (a literal ``row_number`` limit, planned as a WindowGroupLimit that runs before the shuffle);
the low-stock list keeps every low-stock product of the shop, in parts of ``PART_ITEMS``
that are cut by distributed positions (``order.numbered``), so no task ranks a whole shop.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import money_text, name_key
from . import reports as R
from .order import numbered

# Intent names and the answer sentences (must equal the reference's).
RESTOCK = "restock"
BEST = "best_products"
PROFIT_WEEK = "profit_week"
PROFIT_TODAY = "profit_today"
DEBTORS = "debtors"
UNPAID = "unpaid"
LOW_STOCK = "low_stock"
HELP = "help"

RESTOCK_PREFIX = "Restock these products: "
RESTOCK_EMPTY = "No products need restocking right now."
BEST_PREFIX = "Your best-selling products are: "
BEST_EMPTY = "There are no sales yet, so I cannot rank products."
PROFIT_WEEK_PREFIX = "Profit this week is "
PROFIT_TODAY_PREFIX = "Profit today is "
DEBTORS_PREFIX = "Customers with unpaid balances: "
DEBTORS_EMPTY = "No customers currently owe money."
UNPAID_PREFIX = "Total unpaid customer debt is "
LOW_STOCK_PREFIX = "Low-stock products: "
LOW_STOCK_EMPTY = "There are no low-stock products right now."
HELP_TEXT = (
    "Try asking: What should I restock? What are my best products? "
    "How much profit today? How much profit this week? Who owes me money? "
    "What is my total unpaid debt? Or show low stock products."
)
RESTOCK_ITEMS = 8
BEST_ITEMS = 5
DEBTOR_ITEMS = 8
ITEM_SEPARATOR = "; "


def _has(q: Column, word: str) -> Column:
    return q.contains(word)


def intent_of(question: str | Column) -> Column:
    """Q1: the first matching rule wins; plain substrings of the lower-cased text."""
    q = name_key(question)
    return (
        F.when(_has(q, "restock"), F.lit(RESTOCK))
        .when(_has(q, "best") & _has(q, "product"), F.lit(BEST))
        .when(_has(q, "profit") & _has(q, "week"), F.lit(PROFIT_WEEK))
        .when(_has(q, "profit") & (_has(q, "today") | _has(q, "daily")), F.lit(PROFIT_TODAY))
        .when(_has(q, "who") & (_has(q, "owe") | _has(q, "debt")), F.lit(DEBTORS))
        .when(_has(q, "unpaid") | (_has(q, "total") & _has(q, "debt")), F.lit(UNPAID))
        .when(_has(q, "low") & _has(q, "stock"), F.lit(LOW_STOCK))
        .otherwise(F.lit(HELP))
    )


def question_intent(questions: DataFrame) -> DataFrame:
    return questions.withColumn("intent", intent_of("question"))


def _item_list(items: DataFrame, order: list[str], item: Column) -> DataFrame:
    """``(shop_id, text)``: the shop's items joined in ``order``.

    ``items`` is already bounded per shop (top-k, or the shop's low-stock
    products); ordering happens on that small per-shop array.
    """
    packed = items.select("shop_id", F.struct(*[F.col(c) for c in order], item.alias("_item")).alias("_e"))
    return packed.groupBy("shop_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda e: e["_item"]), ITEM_SEPARATOR).alias(
            "text"
        )
    )


def _sentence(base: DataFrame, lists: DataFrame, intent: str, prefix: str, empty: str) -> DataFrame:
    j = base.join(lists, "shop_id", "left")
    return j.select(
        "shop_id",
        F.lit(intent).alias("intent"),
        F.when(F.col("text").isNull(), F.lit(empty))
        .otherwise(F.concat(F.lit(prefix), F.col("text"), F.lit(".")))
        .alias("answer"),
    )


def _shop_ids(shops: DataFrame) -> DataFrame:
    return shops.select(F.col("id").alias("shop_id"))


def answer_restock(shops: DataFrame, products: DataFrame, sales: DataFrame, today: date) -> DataFrame:
    """Q2: the first 8 recommendations with stock and reason."""
    reco = R.restock_recommendations(products, sales, today)
    top = R.rank_within_shop(reco, R.recommendation_order(), RESTOCK_ITEMS, "pos")
    item = F.concat(
        F.col("name"), F.lit(" ("), F.col("stock_quantity").cast("string"), F.lit(" left: "),
        F.col("recommendation_reason"), F.lit(")"),
    )
    return _sentence(_shop_ids(shops), _item_list(top, ["pos"], item), RESTOCK, RESTOCK_PREFIX, RESTOCK_EMPTY)


def answer_best(shops: DataFrame, sales: DataFrame) -> DataFrame:
    """Q3: the all-time top 5 with units."""
    top = R.top_selling_products(sales, BEST_ITEMS)
    item = F.concat(F.col("product_name"), F.lit(" ("), F.col("units_sold").cast("string"), F.lit(" units)"))
    return _sentence(_shop_ids(shops), _item_list(top, ["rank"], item), BEST, BEST_PREFIX, BEST_EMPTY)


def answer_profit(shops: DataFrame, products: DataFrame, sales: DataFrame, today: date) -> DataFrame:
    """Q4: week-to-date and today's profit as money text (two rows per shop)."""
    base = _shop_ids(shops)
    # Today lies inside Monday..today, so one aggregate over the week's rows
    # (a pushed-down date range) gives both figures.
    sums = R.week_sales(sales, today).groupBy("shop_id").agg(
        F.sum("profit").alias("w"),
        F.sum(F.when(F.col("sale_date") == F.lit(today), F.col("profit"))).alias("d"),
    )
    j = base.join(sums, "shop_id", "left")
    zero = F.lit(0).cast("decimal(12,2)")

    def row(intent: str, prefix: str, value: str) -> Column:
        text = F.concat(F.lit(prefix), money_text(F.coalesce(value, zero)), F.lit("."))
        return F.struct(F.lit(intent).alias("intent"), text.alias("answer"))

    # Both rows come out of the one aggregate (a union of two projections
    # would plan the scan twice).
    return j.select(
        "shop_id",
        F.inline(F.array(row(PROFIT_WEEK, PROFIT_WEEK_PREFIX, "w"), row(PROFIT_TODAY, PROFIT_TODAY_PREFIX, "d"))),
    )


def answer_debtors(shops: DataFrame, customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Q5: the 8 largest unpaid balances."""
    b = R.balance_totals(customers, debts).where(F.col("remaining_balance") > 0)
    top = R.rank_within_shop(b, R.balance_order(), DEBTOR_ITEMS, "pos")
    item = F.concat(F.col("customer_name"), F.lit(" ("), money_text("remaining_balance"), F.lit(")"))
    return _sentence(_shop_ids(shops), _item_list(top, ["pos"], item), DEBTORS, DEBTORS_PREFIX, DEBTORS_EMPTY)


def answer_unpaid(shops: DataFrame, customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Q6: total unpaid debt as money text."""
    per_shop = (
        R.balance_totals(customers, debts)
        .groupBy("shop_id")
        .agg(F.sum(F.greatest(F.col("remaining_balance"), F.lit(0).cast("decimal(12,2)"))).alias("u"))
    )
    j = _shop_ids(shops).join(per_shop, "shop_id", "left")
    total = F.coalesce("u", F.lit(0).cast("decimal(12,2)"))
    return j.select(
        "shop_id",
        F.lit(UNPAID).alias("intent"),
        F.concat(F.lit(UNPAID_PREFIX), money_text(total), F.lit(".")).alias("answer"),
    )


PART_ITEMS = 1000  # items of one part of an unbounded list


def answer_low_stock(shops: DataFrame, products: DataFrame) -> DataFrame:
    """Q7: every low-stock product of the shop, lowest stock first, in numbered parts of ``PART_ITEMS`` items."""
    low = products.where(F.col("stock_quantity") <= F.col("low_stock_threshold"))
    item = F.concat(F.col("name"), F.lit(" ("), F.col("stock_quantity").cast("string"), F.lit(" left)"))
    low = low.select("shop_id", "stock_quantity", "name")
    ranked = numbered(low, ["stock_quantity", "name"], "pos", ["shop_id"])
    packed = ranked.select("shop_id", _part("pos").alias("part"), F.struct("pos", item.alias("_item")).alias("_e"))
    texts = packed.groupBy("shop_id", "part").agg(_joined("_e").alias("text"))
    j = _shop_ids(shops).join(texts, "shop_id", "left")
    answer = F.concat(F.lit(LOW_STOCK_PREFIX), F.col("text"), F.lit("."))
    return j.select(
        "shop_id",
        F.lit(LOW_STOCK).alias("intent"),
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(answer, F.lit(LOW_STOCK_EMPTY)).alias("answer"),
    )


def _part(rank: str) -> Column:
    return F.floor((F.col(rank) - 1) / PART_ITEMS).cast("int")


def _joined(entries: str) -> Column:
    """Items of collected (position, item) entries, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(entries)), lambda e: e["_item"]), ITEM_SEPARATOR)


NUMBER = "decimal(24,4)"
ITEM = (
    "array<struct<intent:string,late:boolean,first:decimal(24,4),second:decimal(24,4),name:string,exact:string,"
    "text:string,value:decimal(38,4)>>"
)


def _item(intent: str, keep: Column, first, second, name, text: Column | None, value: Column | None = None, exact=None, late=None):
    """One entry of a shop's answer: its order (late, first, second, name, exact), its text or the value it adds."""
    number = lambda x: (F.lit(None) if x is None else x).cast(NUMBER)
    plain = lambda x: (F.lit(None) if x is None else x).cast("string")
    entry = F.struct(
        F.lit(intent).alias("intent"),
        (F.lit(False) if late is None else late).alias("late"),
        number(first).alias("first"),
        number(second).alias("second"),
        plain(name).alias("name"),
        plain(exact).alias("exact"),
        plain(text).alias("text"),
        (F.lit(None) if value is None else value).cast("decimal(38,4)").alias("value"),
    )
    return F.when(keep, entry)


def _entries(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(ITEM)


def _stock_entries(products: DataFrame, sales: DataFrame, today: date) -> DataFrame:
    """Entries of Q2, Q3 and Q4 from one scan of the sales and one of the products.

    Sales are summed per (shop, product id, name) with conditional sums for the
    periods; each sum then counts for its name (best sellers), its product
    (7-day units) and its shop (profits).  Product rows join the same grouping.
    """
    day = F.col("sale_date")
    recent = day.between(F.lit(today - timedelta(days=R.WINDOW_DAYS - 1)), F.lit(today)) & F.col("product_id").isNotNull()
    week = day.between(F.lit(R.week_start(today)), F.lit(today))
    sums = R.dated_sales(sales).groupBy("shop_id", "product_id", "product_name").agg(
        F.sum("quantity").cast("long").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.sum(F.when(recent, F.col("quantity"))).cast("long").alias("recent"),
        F.sum(F.when(week, F.col("profit"))).alias("week"),
        F.sum(F.when(day == F.lit(today), F.col("profit"))).alias("day"),
    )
    money = "decimal(24,2)"
    fields = {
        "name": "string", "ref": "long", "units": "long", "revenue": money, "recent": "long", "week": money, "day": money,
        "p": "struct<name:string,stock:int,low:int>",
    }

    def row(kind: str, **given: Column) -> Column:
        cells = [(given.get(k, F.lit(None))).cast(t).alias(k) for k, t in fields.items()]
        return F.struct(F.lit(kind).alias("kind"), *cells)

    c = F.col
    by_name = row("name", name=c("product_name"), units=c("units"), revenue=c("revenue"))
    by_product = row("product", ref=c("product_id"), recent=c("recent"))
    by_shop = row("shop", week=c("week"), day=c("day"))
    sold = sums.select("shop_id", F.inline(F.array(by_name, by_product, by_shop)))
    known = products.select(
        "shop_id",
        F.inline(F.array(row("product", ref=c("id"), p=F.struct(c("name"), c("stock_quantity"), c("low_stock_threshold"))))),
    )
    facts = sold.unionByName(known).groupBy("shop_id", "kind", "name", "ref").agg(
        *[F.sum(k).alias(k) for k in ("units", "revenue", "recent", "week", "day")], F.max("p").alias("p")
    )
    units = F.coalesce(c("recent"), F.lit(0)).cast("int")
    days = F.when(units > 0, c("p.stock").cast("double") / (units.cast("double") / F.lit(float(R.WINDOW_DAYS))))
    low = c("p.stock") <= c("p.low")
    soon = F.coalesce(days < R.SOON_DAYS, F.lit(False))
    why = F.when(low & soon, F.lit(R.LOW_AND_SOON)).when(low, F.lit(R.LOW_ONLY)).otherwise(F.lit(R.SOON_ONLY))
    stock = c("p.stock").cast("string")
    is_product = (c("kind") == "product") & c("p").isNotNull()
    shown = R.py_round1(days)
    named = (c("kind") == "name") & c("name").isNotNull()
    entries = _entries(
        _item(BEST, named, -c("units"), -c("revenue"), c("name"),
              F.concat(c("name"), F.lit(" ("), c("units").cast("string"), F.lit(" units)"))),
        _item(RESTOCK, is_product & (low | soon), shown, c("p.stock"), c("p.name"),
              F.concat(c("p.name"), F.lit(" ("), stock, F.lit(" left: "), why, F.lit(")")), late=shown.isNull()),
        _item(PROFIT_WEEK, c("kind") == "shop", None, None, None, None, c("week")),
        _item(PROFIT_TODAY, c("kind") == "shop", None, None, None, None, c("day")),
    )
    return facts.select("shop_id", F.inline(entries))


def _balance_entries(customers: DataFrame, debts: DataFrame) -> DataFrame:
    """Entries of Q5 and Q6 from one table of balances."""
    left = F.col("remaining_balance")
    zero = F.lit(0).cast("decimal(12,2)")
    name = F.col("customer_name")
    entries = _entries(
        _item(DEBTORS, left > 0, -left, None, F.lower(name),
              F.concat(name, F.lit(" ("), money_text("remaining_balance"), F.lit(")")), exact=name),
        _item(UNPAID, F.lit(True), None, None, None, None, F.greatest(left, zero)),
    )
    return R.balance_totals(customers, debts).select("shop_id", F.inline(entries))


LISTS = {
    RESTOCK: (RESTOCK_ITEMS, RESTOCK_PREFIX, RESTOCK_EMPTY),
    BEST: (BEST_ITEMS, BEST_PREFIX, BEST_EMPTY),
    DEBTORS: (DEBTOR_ITEMS, DEBTORS_PREFIX, DEBTORS_EMPTY),
}
MOST_ITEMS = max(most for most, _, _ in LISTS.values())
VALUES = {PROFIT_WEEK: PROFIT_WEEK_PREFIX, PROFIT_TODAY: PROFIT_TODAY_PREFIX, UNPAID: UNPAID_PREFIX}


def answer_table(
    shops: DataFrame,
    products: DataFrame,
    sales: DataFrame,
    customers: DataFrame,
    debts: DataFrame,
    today: date,
) -> DataFrame:
    """``(shop_id, intent, part, answer)`` for every shop and every intent but help.

    Sales, debts and customers are each read once; the capped lists and the values
    share one ranking and one grouping.  The unbounded low-stock list comes in numbered parts.
    """
    entries = _stock_entries(products, sales, today).unionByName(_balance_entries(customers, debts))
    listed = entries.groupBy("shop_id", "intent", "late", "first", "second", "name", "exact", "text").agg(
        F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")
    )
    # equal items are rows of their own again, as many as a list can show; a value is one row
    copies = F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.least("n", F.lit(MOST_ITEMS)).cast("int"))
    rows = listed.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    order = Window.partitionBy("shop_id", "intent").orderBy("late", "first", "second", "name", "exact", "text")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_ITEMS)
    limit = F.lit(MOST_ITEMS)
    for intent, (most, _, _) in LISTS.items():
        limit = F.when(F.col("intent") == intent, F.lit(most)).otherwise(limit)
    entry = F.struct(F.col("rank").alias("pos"), F.col("text").alias("_item"))
    kept = ranked.where(F.col("rank") <= limit)
    kept = kept.select("shop_id", "intent", F.when(F.col("text").isNotNull(), entry).alias("_e"), "value")
    texts = kept.groupBy("shop_id", "intent").agg(_joined("_e").alias("text"), F.sum("value").alias("value"))
    intents = F.explode(F.array(*[F.lit(i) for i in (*LISTS, *VALUES)]))
    base = _shop_ids(shops).select("shop_id", intents.alias("intent"))
    j = base.join(texts, ["shop_id", "intent"], "left")
    answer = F.lit(None).cast("string")
    for intent, (_, prefix, empty) in LISTS.items():
        sentence = F.when(F.col("text").isNull(), F.lit(empty)).otherwise(F.concat(F.lit(prefix), F.col("text"), F.lit(".")))
        answer = F.when(F.col("intent") == intent, sentence).otherwise(answer)
    for intent, prefix in VALUES.items():
        money = money_text(F.coalesce(F.col("value"), F.lit(0).cast("decimal(38,4)")))
        answer = F.when(F.col("intent") == intent, F.concat(F.lit(prefix), money, F.lit("."))).otherwise(answer)
    bounded = j.select("shop_id", "intent", F.lit(0).alias("part"), answer.alias("answer"))
    return bounded.unionByName(answer_low_stock(shops, products))


def assistant_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Q8: each question with its intent and answer (a row per part); unmatched → the help text."""
    q = question_intent(questions)
    a = answers.select(F.col("shop_id").alias("a_shop_id"), F.col("intent").alias("a_intent"), "part", "answer")
    j = q.join(a, (F.col("shop_id") == F.col("a_shop_id")) & (F.col("intent") == F.col("a_intent")), "left")
    return j.select(
        "question_id",
        "shop_id",
        "question",
        "intent",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce(F.col("answer"), F.lit(HELP_TEXT)).alias("answer"),
    )
