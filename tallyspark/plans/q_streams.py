"""Streams on shared tables (ST1, S12): micro-batches of several writers, applied as ``foreachBatch`` does."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import name_key, to_double
from ..operators import ledger as L
from ..operators import reports as R
from ..schemas import CUSTOMERS, PRODUCTS
from ..session import scratch_path
from ..sources import fixtures as fx
from ..sources import sinks
from ..sources.sinks import read_snapshot, write_snapshot
from ..streaming import ingest as I
from .oracle_tables import with_tables
from .q_ledger import V4
from .registry import ORACLES, query

TWO_WRITERS = (
    f", nd AS (SELECT shop_id, lower(trim(customer_name)) AS nk, 2 * (seq % 2) AS phase, command_date AS day, seq AS id, "
    f"false AS take, CAST(amount AS DECIMAL(12,2)) AS asked, CAST(amount AS DECIMAL(12,2)) AS rounded FROM t_debt_commands "
    f"WHERE {V4} = ''), "
    "cr AS (SELECT d.shop_id, lower(trim(c.name)) AS nk, 2 * (d.id % 2) + 1 AS phase, d.transaction_date AS day, d.id, "
    "d.transaction_type = 'payment' AS take, d.amount AS asked, CAST(d.amount AS DECIMAL(12,2)) AS rounded "
    "FROM t_credit_commands d JOIN t_customers c ON c.shop_id = d.shop_id AND c.id = d.customer_id "
    "WHERE d.transaction_type IN ('debt', 'payment') AND CAST(d.amount AS DECIMAL(12,2)) > 0), "
    "ev AS (SELECT *, row_number() OVER (PARTITION BY shop_id, nk ORDER BY phase, day, id) AS rn "
    "FROM (SELECT * FROM nd UNION ALL SELECT * FROM cr)), "
    "walk AS (SELECT shop_id, nk, CAST(0 AS BIGINT) AS rn, false AS ok, CAST(0 AS DECIMAL(18,2)) AS lvl FROM ev "
    "GROUP BY shop_id, nk UNION ALL SELECT e.shop_id, e.nk, e.rn, NOT e.take OR e.asked <= w.lvl, "
    "CAST(CASE WHEN NOT e.take THEN w.lvl + e.rounded WHEN e.asked <= w.lvl THEN w.lvl - e.rounded ELSE w.lvl END "
    "AS DECIMAL(18,2)) FROM walk w JOIN ev e ON e.shop_id = w.shop_id AND e.nk = w.nk AND e.rn = w.rn + 1)\n"
)


@query(
    "stream_two_writers",
    with_tables(
        TWO_WRITERS
        + "SELECT e.shop_id, e.nk AS name_key, CAST(max_by(w.lvl, w.rn) AS DOUBLE) AS balance, "
        "CAST(count(*) FILTER (WHERE w.ok AND NOT e.take) AS BIGINT) AS n_debts, "
        "CAST(count(*) FILTER (WHERE w.ok AND e.take) AS BIGINT) AS n_payments, "
        "CAST(sum(CASE WHEN NOT w.ok THEN 0 WHEN e.take THEN -e.rounded ELSE e.rounded END) AS DOUBLE) AS ledger_total "
        "FROM ev e JOIN walk w ON w.shop_id = e.shop_id AND w.nk = e.nk AND w.rn = e.rn GROUP BY ALL "
        "HAVING count(*) FILTER (WHERE w.ok) > 0",
        "t_debt_commands",
        "t_credit_commands",
        "t_customers",
        recursive=True,
    ),
)
def stream_two_writers(t):
    """ST1/S12: new debts by name and payments as two streams on one ledger and one set of balances, two
    batches each, in turn, then all of them replayed: what is left in ledger and balances."""
    spark = t.spark
    root = scratch_path(spark, "two-writers")
    cust, bal, led = (f"{root}/{n}" for n in ("customers", "balances", "ledger"))
    write_snapshot(spark, fx.customers(t), cust)
    named = fx.debt_commands(t).select(*[F.col(f.name).cast(f.dataType) for f in I.NAMED_DEBTS.fields])
    credit = fx.credit_commands(t).select(*[F.col(f.name).cast(f.dataType) for f in I.CREDIT_COMMANDS.fields])
    for replayed in (False, True):
        for batch in (0, 1):
            done = [
                I.apply_named_debts(spark, named.where(F.col("seq") % 2 == batch), batch, cust, bal, led),
                I.apply_credit_batch(spark, credit.where(F.col("id") % 2 == batch), batch, cust, bal, led),
            ]
            if done != [not replayed] * 2:
                raise AssertionError(f"batch {batch} of the streams, replayed={replayed}: applied {done}")
    keys = read_snapshot(spark, cust, CUSTOMERS).select("shop_id", F.col("id").alias("customer_id"), name_key("name").alias("name_key"))
    kind, amount = F.col("transaction_type"), F.col("amount")
    sums = I.ledger(spark, led, "debt_transactions").groupBy("shop_id", "customer_id").agg(
        F.count(F.when(kind == "debt", 1)).alias("n_debts"),
        F.count(F.when(kind == "payment", 1)).alias("n_payments"),
        to_double(F.sum(F.when(kind == "debt", amount).otherwise(-amount))).alias("ledger_total"),
    )
    balances = read_snapshot(spark, bal, I.BALANCES).select("shop_id", "customer_id", to_double("balance").alias("balance"))
    found = sums.join(balances, ["shop_id", "customer_id"], "full").join(keys, ["shop_id", "customer_id"], "left")
    return found.select("shop_id", "name_key", "balance", "n_debts", "n_payments", "ledger_total")


@query("snapshot_deltas", ORACLES["apply_restocks_stock"])
def snapshot_deltas(t):
    """Restocks of four periods, each committed as a delta of the products it touches, with a compaction
    and the removal of old versions between them."""
    spark = t.spark
    table = scratch_path(spark, "snapshot-deltas")
    write_snapshot(spark, fx.products(t), table)
    commands = fx.restock_commands(t)
    cuts = ["1993-06-01", "1995-01-01", "1996-09-01"]
    for n, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        day = F.coalesce(F.col("command_date"), F.lit("1900-01-01").cast("date"))
        part = commands.where(F.lit(True) if low is None else day >= F.lit(low)).where(F.lit(True) if high is None else day < F.lit(high))
        touched = part.select("shop_id", F.col("product_id").alias("id")).distinct()
        meta = sinks.snapshot_meta(spark, table)
        now = read_snapshot(spark, table, PRODUCTS, meta, touched).join(touched, I.PRODUCT_KEYS, "left_semi")
        after = L.apply_restocks_stock(now, part)
        sinks.update_snapshot(spark, after, table, I.PRODUCT_KEYS, {"batch_id": n, "stream": I.STOCK}, base=meta, buckets=16)
        if n == 1:
            sinks.compact_snapshot(spark, table, PRODUCTS)
            sinks.remove_old_versions(spark, table, keep=1)
    return R.product_list(read_snapshot(spark, table, PRODUCTS))
