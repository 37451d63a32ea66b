"""Restocking recommendations against a plain-Python computation of the rules,
rounding with Python's own ``round`` (the parity the reports must keep)."""

from __future__ import annotations

from datetime import timedelta

from conftest import TODAY, d, products_df
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tallyspark import schemas as S
from tallyspark.operators import reports as R

PRODUCT = st.tuples(st.integers(min_value=0, max_value=60), st.integers(min_value=0, max_value=20))
SALE = st.tuples(st.integers(min_value=0, max_value=5), st.integers(min_value=0, max_value=12),
                 st.integers(min_value=1, max_value=40))


def expected(products, sales):
    units = {}
    for pid, days_ago, q in sales:
        if days_ago <= 6:
            units[pid] = units.get(pid, 0) + q
    out = {}
    for pid, (stock, thr) in enumerate(products):
        u = units.get(pid, 0)
        avg = u / 7
        days = stock / avg if avg > 0 else None
        low = stock <= thr
        soon = days is not None and days < 3
        if low or soon:
            reason = R.LOW_AND_SOON if low and soon else (R.LOW_ONLY if low else R.SOON_ONLY)
            out[pid] = (u, round(avg, 2), None if days is None else round(days, 1), reason)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(products=st.lists(PRODUCT, min_size=1, max_size=6), sales=st.lists(SALE, max_size=25))
def test_recommendations_match_python_rules(spark, products, sales):
    sales = [(pid % len(products), days_ago, q) for pid, days_ago, q in sales]
    p = products_df(spark, [(1, i, f"p{i}", "c", 1, 2, s, t) for i, (s, t) in enumerate(products)])
    rows = [(1, f"s{k}", pid, f"p{pid}", q, TODAY - timedelta(days=days_ago), d(2 * q), d(q))
            for k, (pid, days_ago, q) in enumerate(sales)]
    s = spark.createDataFrame(rows, S.SALES)
    got = {r.product_id: (r.units_sold_7d, r.average_daily_sales, r.estimated_days_until_stockout,
                          r.recommendation_reason) for r in R.restock_recommendations(p, s, TODAY).collect()}
    assert got == expected(products, sales)


def test_rounding_sweep_over_stock_and_units(spark):
    """Every (stock, units) pair with stock 0..40 and units 1..60 in one job."""
    pairs = [(stock, units) for stock in range(41) for units in range(1, 61)]
    p = products_df(spark, [(1, i, f"p{i}", "c", 1, 2, stock, 0) for i, (stock, _) in enumerate(pairs)])
    rows = [(1, f"s{i}", i, f"p{i}", units, TODAY, d(units), d(units)) for i, (_, units) in enumerate(pairs)]
    got = {r.product_id: r for r in R.restock_recommendations(p, spark.createDataFrame(rows, S.SALES), TODAY).collect()}
    for i, (stock, units) in enumerate(pairs):
        avg = units / 7
        days = stock / avg
        listed = stock <= 0 or days < 3
        assert (i in got) == listed, (stock, units)
        if listed:
            assert got[i].average_daily_sales == round(avg, 2), (stock, units)
            assert got[i].estimated_days_until_stockout == round(days, 1), (stock, units)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(sales=st.lists(st.tuples(st.integers(min_value=0, max_value=2), st.sampled_from("ABCDEFG"),
                                st.integers(min_value=1, max_value=3), st.integers(min_value=1, max_value=3)),
                      min_size=1, max_size=30))
def test_top_k_matches_python_sort(spark, sales):
    """Units desc, revenue desc, name asc; ties are common with these small values."""
    rows = [(shop, f"s{k}", 1, name, q, TODAY, d(rev), d(0)) for k, (shop, name, q, rev) in enumerate(sales)]
    got = {(r.shop_id, r.rank): (r.product_name, r.units_sold, r.revenue)
           for r in R.top_selling_products(spark.createDataFrame(rows, S.SALES), 3).collect()}
    want = {}
    for shop in {s for s, *_ in sales}:
        agg = {}
        for s, name, q, rev in sales:
            if s == shop:
                u, r = agg.get(name, (0, 0))
                agg[name] = (u + q, r + rev)
        ranked = sorted(agg.items(), key=lambda kv: (-kv[1][0], -kv[1][1], kv[0]))[:3]
        for rank, (name, (u, r)) in enumerate(ranked, start=1):
            want[(shop, rank)] = (name, u, float(r))
    assert got == want


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.integers(min_value=0, max_value=4), st.sampled_from(["debt", "payment"]),
                               st.integers(min_value=1, max_value=50000)), max_size=30))
def test_balances_and_unpaid_match_python(spark, rows):
    """Customers 0..4 of one shop; negative balances count 0 in the unpaid total."""
    customers = spark.createDataFrame([(1, c, f"C{c}", None) for c in range(5)], S.CUSTOMERS)
    debts = spark.createDataFrame(
        [(1, k, c, f"C{c}", kind, d(cents / 100), None, TODAY) for k, (c, kind, cents) in enumerate(rows)], S.DEBTS
    )
    shops = spark.createDataFrame([(1, "S", 1)], S.SHOPS)
    want = {c: [0, 0] for c in range(5)}
    for c, kind, cents in rows:
        want[c][0 if kind == "debt" else 1] += cents
    got = {r.customer_id: r for r in R.customer_balances(customers, debts).collect()}
    for c, (debt, paid) in want.items():
        assert (got[c].total_debt, got[c].total_paid, got[c].remaining_balance) == (
            debt / 100, paid / 100, (debt - paid) / 100)
    unpaid = R.total_unpaid_debt(shops, customers, debts).collect()[0].total_unpaid
    assert unpaid == sum(max(debt - paid, 0) for debt, paid in want.values()) / 100


WORDS = ["restock", "best", "product", "profit", "week", "weekly", "today", "daily", "who", "owe", "debt",
         "unpaid", "total", "low", "stock", "Stock", "PROFIT", " ", "?", "x"]


def python_intent(question):
    from tallyspark.operators import answers as A

    q = question.strip().lower()
    rules = [
        ("restock" in q, A.RESTOCK),
        ("best" in q and "product" in q, A.BEST),
        ("profit" in q and ("week" in q or "weekly" in q), A.PROFIT_WEEK),
        ("profit" in q and ("today" in q or "daily" in q), A.PROFIT_TODAY),
        ("who" in q and ("owe" in q or "debt" in q), A.DEBTORS),
        ("unpaid" in q or ("total" in q and "debt" in q), A.UNPAID),
        ("low" in q and "stock" in q, A.LOW_STOCK),
    ]
    return next((intent for hit, intent in rules if hit), A.HELP)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(qs=st.lists(st.lists(st.sampled_from(WORDS), max_size=5).map("".join), min_size=1, max_size=40))
def test_intents_match_python_rules(spark, qs):
    from tallyspark.operators import answers as A

    df = spark.createDataFrame([(i, 1, q) for i, q in enumerate(qs)], S.QUESTIONS)
    got = {r.question_id: r.intent for r in A.question_intent(df).collect()}
    assert got == {i: python_intent(q) for i, q in enumerate(qs)}
