"""Hand-computed cases (FIXTURES.md §4) and report edge cases."""

from __future__ import annotations

from datetime import date, timedelta

from conftest import LEDGER_CMD, RESTOCK_CMD, SALE_CMD, TODAY, d, products_df

from tallyspark import schemas as S
from tallyspark.operators import answers as A
from tallyspark.operators import ledger as L
from tallyspark.operators import reports as R


def _sales(spark, rows):
    """rows: (shop_id, id, product_id, product_name, quantity, sale_date, revenue, profit)."""
    return spark.createDataFrame([(s, i, p, n, q, dt, d(rv), d(pf)) for s, i, p, n, q, dt, rv, pf in rows], S.SALES)


def test_fold_is_greedy_not_running_sum(spark):
    p = products_df(spark, [(1, 1, "A", "c", 1, 2, 10, 0)])
    cmd = spark.createDataFrame(
        [(1, 1, f"s{i}", TODAY + timedelta(days=i), q) for i, q in enumerate([5, 8, 5, 1])], SALE_CMD
    )
    out = sorted(L.apply_sales(p, cmd).collect(), key=lambda r: r.sale_date)
    assert [r.status for r in out] == ["accepted", "rejected", "accepted", "rejected"]
    assert L.apply_sales_stock(p, cmd).collect()[0].stock_quantity == 0


def test_timeline_interleaved_and_price(spark):
    p = products_df(spark, [(1, 1, "A", "c", 4, 10, 2, 0)])
    sales = spark.createDataFrame([(1, 1, "s1", TODAY, 3), (1, 1, "s2", TODAY + timedelta(days=2), 3)], SALE_CMD)
    rs = spark.createDataFrame([(1, 1, "r1", TODAY + timedelta(days=1), 5, "X", d(4), False)], RESTOCK_CMD)
    out = {r.id: r for r in L.apply_stock_timeline(p, sales, rs).collect()}
    assert out["s1"].status == "rejected" and out["s2"].status == "accepted"

    p = products_df(spark, [(1, 1, "A", "c", 4, 10, 5, 0)])
    sales = spark.createDataFrame([(1, 1, "s1", TODAY, 1), (1, 1, "s2", TODAY + timedelta(days=2), 1)], SALE_CMD)
    rs = spark.createDataFrame([(1, 1, "r1", TODAY + timedelta(days=1), 1, "X", d(6), True)], RESTOCK_CMD)
    out = {r.id: r for r in L.apply_stock_timeline(p, sales, rs).collect()}
    assert (out["s1"].profit, out["s2"].profit) == (6.0, 4.0)


def test_payment_fold(spark):
    customers = spark.createDataFrame([(1, 7, "A", None)], S.CUSTOMERS)
    led = spark.createDataFrame(
        [(1, i + 1, 7, t, d(a), TODAY + timedelta(days=i)) for i, (t, a) in
         enumerate([("debt", 100), ("payment", 60), ("payment", 50), ("payment", 40)])],
        LEDGER_CMD,
    )
    out = {r.id: r.status for r in L.apply_payments(customers, led).collect()}
    assert [out[i] for i in (2, 3, 4)] == ["accepted", "rejected", "accepted"]


def test_amount_rounding_to_zero_rejected(spark):
    cmd = spark.createDataFrame(
        [(1, 1, "A", " ", 0.004, None, TODAY)],
        "shop_id long, seq long, customer_name string, phone string, amount double, note string, command_date date",
    )
    r = L.validate_debts(cmd).collect()[0]
    assert not r.accepted and r.reasons == "amount_not_positive"


def _reco(spark, stock, units, thr):
    p = products_df(spark, [(1, 1, "P", "c", 1, 2, stock, thr)])
    rows = [(1, "s1", 1, "P", units, TODAY, 1, 1)] if units else []
    return R.restock_recommendations(p, _sales(spark, rows), TODAY).collect()


def test_days_left_rounds_like_python(spark):
    r = _reco(spark, 1, 20, 0)[0]
    assert r.estimated_days_until_stockout == 0.3
    assert r.recommendation_reason == R.SOON_ONLY


def test_qualifies_although_shown_as_three(spark):
    r = _reco(spark, 37, 87, 5)
    assert len(r) == 1 and r[0].estimated_days_until_stockout == 3.0
    assert r[0].recommendation_reason == R.SOON_ONLY


def test_never_sold_empty_product_sorted_last(spark):
    p = products_df(spark, [(1, 1, "Empty", "c", 1, 2, 0, 5), (1, 2, "Busy", "c", 1, 2, 3, 1)])
    s = _sales(spark, [(1, "s1", 2, "Busy", 70, TODAY, 1, 1)])
    rows = R.restock_recommendations(p, s, TODAY).orderBy(*R.recommendation_order()).collect()
    assert [r.name for r in rows] == ["Busy", "Empty"]
    assert rows[1].estimated_days_until_stockout is None
    assert rows[1].recommendation_reason == R.LOW_ONLY


def test_deleted_product_kept_in_ranking_not_in_7d(spark):
    s = _sales(spark, [(1, "s1", None, "Gone", 4, TODAY, 8, 2), (1, "s2", 1, "Here", 3, TODAY, 6, 1)])
    top = {r.product_name for r in R.top_selling_products(s).collect()}
    assert top == {"Gone", "Here"}
    assert [r.product_id for r in R.units_sold_7d(s, TODAY).collect()] == [1]


def test_customer_without_rows_and_negative_balance(spark):
    c = spark.createDataFrame([(1, 1, "NoRows", None), (1, 2, "Over", "06")], S.CUSTOMERS)
    debts = spark.createDataFrame(
        [(1, 1, 2, "Over", "debt", d(100), None, TODAY), (1, 2, 2, "Over", "payment", d(120), None, TODAY)], S.DEBTS
    )
    b = {r.customer_name: r for r in R.customer_balances(c, debts).collect()}
    assert (b["NoRows"].total_debt, b["NoRows"].total_paid, b["NoRows"].remaining_balance) == (0.0, 0.0, 0.0)
    assert b["Over"].remaining_balance == -20.0
    shops = spark.createDataFrame([(1, "S", 1)], S.SHOPS)
    assert R.total_unpaid_debt(shops, c, debts).collect()[0].total_unpaid == 0.0


def test_ranking_tie_breaks_on_name(spark):
    s = _sales(spark, [(1, "s1", 2, "Beta", 5, TODAY, 10, 1), (1, "s2", 1, "Alpha", 5, TODAY, 10, 1)])
    rows = R.top_selling_products(s).orderBy("rank").collect()
    assert [r.product_name for r in rows] == ["Alpha", "Beta"]


def test_bad_date_text_dropped(spark):
    rows = spark.createDataFrame(
        [(1, "a", "2026-06-12"), (1, "b", "bad"), (1, "c", "06/13/2026")], "shop_id long, id string, sale_date string"
    )
    out = R.parse_sale_dates(rows).collect()
    assert [r.id for r in out] == ["a"] and out[0].sale_date == date(2026, 6, 12)


def test_question_rules_in_order(spark):
    q = spark.createDataFrame(
        [(1, 1, "Should I restock my best product?"), (2, 1, "   Who OWES me?   "), (3, 1, "Weekly profit?"),
         (4, 1, "daily profit"), (5, 1, "total debt"), (6, 1, "LOW STOCK"), (7, 1, "hello"), (8, 1, None)],
        S.QUESTIONS,
    )
    got = {r.question_id: r.intent for r in A.question_intent(q).collect()}
    assert got == {1: A.RESTOCK, 2: A.DEBTORS, 3: A.PROFIT_WEEK, 4: A.PROFIT_TODAY, 5: A.UNPAID,
                   6: A.LOW_STOCK, 7: A.HELP, 8: A.HELP}


def test_answers_text_and_empty_variants(spark):
    shops = spark.createDataFrame([(1, "S1", 1), (2, "S2", 2)], S.SHOPS)
    p = products_df(spark, [(1, 1, "Rice", "Food", 1, 2, 3, 5), (2, 2, "Salt", "Food", 1, 2, 50, 5)])
    s = _sales(spark, [(1, "s1", 1, "Rice", 14, TODAY, 1234.5, 1234.5)])
    c = spark.createDataFrame([(1, 1, "Amina", None)], S.CUSTOMERS)
    debts = spark.createDataFrame([(1, 1, 1, "Amina", "debt", d(1500), None, TODAY)], S.DEBTS)
    ans = {(r.shop_id, r.intent): r.answer for r in A.answer_table(shops, p, s, c, debts, TODAY).collect()}
    assert ans[(1, A.RESTOCK)] == "Restock these products: Rice (3 left: " + R.LOW_AND_SOON + ")."
    assert ans[(2, A.RESTOCK)] == A.RESTOCK_EMPTY
    assert ans[(1, A.BEST)] == "Your best-selling products are: Rice (14 units)."
    assert ans[(2, A.BEST)] == A.BEST_EMPTY
    assert ans[(1, A.PROFIT_TODAY)] == "Profit today is 1,234.50 MAD."
    assert ans[(2, A.PROFIT_WEEK)] == "Profit this week is 0.00 MAD."
    assert ans[(1, A.DEBTORS)] == "Customers with unpaid balances: Amina (1,500.00 MAD)."
    assert ans[(2, A.DEBTORS)] == A.DEBTORS_EMPTY
    assert ans[(1, A.UNPAID)] == "Total unpaid customer debt is 1,500.00 MAD."
    assert ans[(1, A.LOW_STOCK)] == "Low-stock products: Rice (3 left)."
    assert ans[(2, A.LOW_STOCK)] == A.LOW_STOCK_EMPTY
    q = spark.createDataFrame([(1, 2, "hi")], S.QUESTIONS)
    assert A.assistant_answers(q, A.answer_table(shops, p, s, c, debts, TODAY)).collect()[0].answer == A.HELP_TEXT


def test_week_starts_monday():
    assert R.week_start(date(1998, 6, 12)) == date(1998, 6, 8)
    assert R.week_start(date(1998, 6, 8)) == date(1998, 6, 8)


def test_generator_weekend_boost_and_skips(spark):
    from tallyspark.operators import generate as G

    p = products_df(spark, [(1, 1, "Ten", "c", 1, 2, 5, 1), (1, 2, "Zero", "c", 1, 2, 5, 1)])
    ranges = spark.createDataFrame([(1, 1, 10, 10), (1, 2, 0, 0)], "shop_id long, product_id long, min_units int, max_units int")
    rows = G.generate_sales(p, ranges, TODAY).collect()
    assert {r.product_id for r in rows} == {1} and len(rows) == G.HISTORY_DAYS
    by_day = {r.sale_date: r.quantity for r in rows}
    assert by_day[date(1998, 6, 13 - 7)] == 12  # Saturday: round(11.5) = 12
    assert by_day[date(1998, 6, 12)] == 10
    assert all(r.revenue == 2.0 * r.quantity and r.profit == 1.0 * r.quantity for r in rows)


def test_update_rejected_when_name_key_is_shared(spark):
    p = products_df(spark, [(1, 1, "Tea", "c", 1, 2, 5, 1), (1, 2, "TEA", "c", 1, 2, 5, 1)])
    upd = spark.createDataFrame(
        [(1, 1, TODAY, "u1", " tea ", "c", d(1), d(2), 5, 1)],
        "shop_id long, id long, command_date date, command_id string, name string, category string, "
        "buy_price decimal(12,2), sell_price decimal(12,2), stock_quantity int, low_stock_threshold int",
    )
    out = L.update_outcomes(p, upd).collect()
    assert len(out) == 1 and not out[0].accepted and out[0].reasons == "duplicate_name"


def test_customer_upsert_rules(spark):
    customers = spark.createDataFrame([(1, 10, "Amina", "0600")], S.CUSTOMERS)
    cmds = spark.createDataFrame(
        [(1, 1, " amina ", "0611", 5.0, None, TODAY),       # existing, any case: phone overwritten
         (1, 2, "AMINA", " ", 5.0, None, TODAY),            # blank phone keeps the last given one
         (1, 3, "Driss", " ", 7.0, None, TODAY),            # new customer, first spelling wins
         (1, 4, "DRISS", "0722", 7.0, None, TODAY),         # same new customer, gives the phone
         (1, 5, "Zed", None, 0.001, None, TODAY)],          # amount rounds to 0.00: rejected, no customer
        "shop_id long, seq long, customer_name string, phone string, amount double, note string, command_date date",
    )
    after = {r.name: r for r in L.upsert_customers(customers, cmds).collect()}
    assert set(after) == {"Amina", "Driss"}
    assert after["Amina"].id == 10 and after["Amina"].phone == "0611"
    assert after["Driss"].id > 10 and after["Driss"].phone == "0722"
    rows = {r.id: r for r in L.apply_debts(customers, cmds).collect()}
    assert rows[1].customer_id == rows[2].customer_id == 10 and rows[1].customer_name == "amina"
    assert rows[3].customer_id == rows[4].customer_id == after["Driss"].id
    assert rows[5].status == "rejected" and rows[5].customer_id is None


def test_delete_sets_null_and_cascades(spark):
    p = products_df(spark, [(1, 1, "Tea", "c", 1, 2, 5, 1), (1, 2, "Rice", "c", 1, 2, 5, 1)])
    s = _sales(spark, [(1, "s1", 1, "Tea", 1, TODAY, 2, 1), (1, "s2", 2, "Rice", 1, TODAY, 2, 1)])
    gone = spark.createDataFrame([(1, 1), (1, 99)], "shop_id long, id long")
    assert {r.id for r in L.delete_products(p, gone).collect()} == {2}
    assert {(r.shop_id, r.id) for r in L.accepted_deletes(p, gone).collect()} == {(1, 1)}
    after = {r.id: r for r in L.null_deleted_refs(s, p, gone).collect()}
    assert after["s1"].product_id is None and after["s1"].product_name == "Tea"
    assert after["s2"].product_id == 2
    debts = spark.createDataFrame(
        [(1, 1, 7, "A", "debt", d(5), None, TODAY), (1, 2, 8, "B", "debt", d(5), None, TODAY)], S.DEBTS
    )
    left = L.cascade_customer_delete(debts, spark.createDataFrame([(1, 7)], "shop_id long, id long"))
    assert [r.customer_id for r in left.collect()] == [8]
