"""ST1: continuous ingest of stock commands (sales and restocks) and of
credit commands (debts and payments).

The reference applies each sale or restock the moment it is entered.  Here
command files land in a folder; Structured Streaming picks up new files and
``foreachBatch`` applies each micro-batch to the current snapshot with the
batch operators: the M9 timeline (M4 sales and M6 restocks on one order per
product) against the product snapshot, and M7 (payments no larger than the
balance) against a balance snapshot.

Several streams may write one ledger and one snapshot (new debts by name and payments share
the balances).  Each has a name of its own and numbers its batches from 0.

Exactly-once per micro-batch:

1. the batch's outcomes go to a folder named by stream and batch id; the accepted
   rows go to the ledger in its declared schema, under the batch's own
   folders, and the rejected rows to a folder of rejects (all replaced on a
   replay, so a retried batch never duplicates rows);
2. the changed rows of the snapshot (products or balances) are written as a delta and
   committed as a new version, whose manifest records the last batch of every stream;
3. a batch whose id is not above its stream's committed one is skipped, so a batch
   replayed after a crash between (2) and the stream's own commit does not
   apply twice;
4. where another stream has committed meanwhile, the commit is refused and the
   batch is applied again to the new version.

A batch reads only the buckets of the snapshot that its keys fall into and writes only the
rows that it changes; deltas are folded into the buckets when there are more than a few.

The stock or balance change is computed from the ledger rows *read back* from storage,
which cuts the lineage between the fold and the snapshot write.  Commands
are ordered within a micro-batch (date, id); a late command is applied in
arrival order, as the reference does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    BooleanType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from ..operators import ledger as L
from ..schemas import CUSTOMERS, DEBTS, MONEY, PRODUCTS
from ..sources.sinks import (
    LEDGER_DATE,
    MAX_DELTAS,
    CommitConflict,
    applied,
    batch_folder,
    compact_snapshot,
    drop_batch,
    read_ledger,
    read_snapshot,
    snapshot_meta,
    table_schemas,
    update_snapshot,
    write_ledger,
)

COMMANDS = StructType(
    [
        StructField("kind", StringType(), False),  # 'sale' | 'restock'
        StructField("shop_id", LongType(), False),
        StructField("product_id", LongType(), True),
        StructField("id", StringType(), False),
        StructField("command_date", DateType(), True),
        StructField("quantity", IntegerType(), True),
        StructField("supplier_name", StringType(), True),
        StructField("unit_buy_price", MONEY, True),
        StructField("update_buy_price", BooleanType(), True),
    ]
)

SALE = "sale"
RESTOCK = "restock"
SALE_COLUMNS = ["shop_id", "product_id", "id", "command_date", "quantity"]
RESTOCK_COLUMNS = SALE_COLUMNS + ["supplier_name", "unit_buy_price", "update_buy_price"]


STOCK, CREDIT, NAMED = "stock", "credit", "named_debts"  # default stream names
PRODUCT_KEYS, BALANCE_KEYS, CUSTOMER_KEYS = ["shop_id", "id"], ["shop_id", "customer_id"], ["shop_id", "id"]


def _until_committed(attempt: Callable[[], bool]) -> bool:
    """Repeat ``attempt`` while other streams commit first; each commit of theirs is progress."""
    while True:
        try:
            return attempt()
        except CommitConflict:
            continue


def _tidy(spark: SparkSession, table_dir: str, schema: StructType) -> None:
    try:
        compact_snapshot(spark, table_dir, schema, MAX_DELTAS)
    except CommitConflict:  # another stream has committed; a later batch will do it
        pass


def split_commands(cmds: DataFrame) -> tuple[DataFrame, DataFrame]:
    sales = cmds.where(F.col("kind") == SALE).select(*SALE_COLUMNS)
    restocks = cmds.where(F.col("kind") == RESTOCK).select(*RESTOCK_COLUMNS)
    return sales, restocks


def _folder(ledger_dir: str, kind: str, name: str, stream: str, batch_id: int) -> str:
    return f"{ledger_dir.rstrip('/')}/{kind}/{name}/stream={stream}/batch_id={batch_id}"


def _outcomes(rows: DataFrame, ledger_dir: str, name: str, stream: str, batch_id: int) -> DataFrame:
    """A batch's outcomes, written once: the ledger, the rejects and the snapshot are read from there."""
    path = _folder(ledger_dir, "outcomes", name, stream, batch_id)
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _reject(rows: DataFrame, ledger_dir: str, name: str, stream: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(_folder(ledger_dir, "rejects", name, stream, batch_id))


def _accept(rows: DataFrame, ledger_dir: str, name: str, stream: str, batch_id: int) -> None:
    """Accepted rows in the ledger's declared schema, under the batch's own folders."""
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in table_schemas()[name].fields])
    path = f"{ledger_dir.rstrip('/')}/{name}"
    drop_batch(rows.sparkSession, path, batch_id, stream)
    write_ledger(typed, path, LEDGER_DATE[name], batch_id, stream)


def ledger(spark: SparkSession, ledger_dir: str, name: str) -> DataFrame:
    """A streamed ledger, readable by every report."""
    return read_ledger(spark, f"{ledger_dir.rstrip('/')}/{name}", table_schemas()[name], LEDGER_DATE[name])


def apply_command_batch(
    spark: SparkSession, cmds: DataFrame, batch_id: int, products_dir: str, ledger_dir: str, stream: str = STOCK
) -> bool:
    """Apply one batch of commands; ``False`` when the batch was already applied."""

    def attempt() -> bool:
        meta = snapshot_meta(spark, products_dir)
        if applied(meta, stream, batch_id):
            return False
        touched = cmds.select("shop_id", F.col("product_id").alias("id")).distinct()
        products = read_snapshot(spark, products_dir, PRODUCTS, meta, touched)
        sales, restocks = split_commands(cmds)
        outcomes = _outcomes(L.apply_stock_timeline(products, sales, restocks), ledger_dir, "sales", stream, batch_id)
        sold = outcomes.where(F.col("status") == L.ACCEPTED)
        _accept(sold, ledger_dir, "sales", stream, batch_id)
        _reject(outcomes.where(F.col("status") != L.ACCEPTED), ledger_dir, "sales", stream, batch_id)
        _accept(L.apply_restocks(products, restocks), ledger_dir, "restocks", stream, batch_id)
        refused = L.validate_restocks(products, restocks).where(~F.col("accepted"))
        _reject(refused, ledger_dir, "restocks", stream, batch_id)
        units = sold.select("shop_id", "product_id", F.col("quantity").alias("units"))
        moved = products.join(touched, PRODUCT_KEYS, "left_semi")
        after = L.stock_after(L.apply_restocks_stock(moved, restocks), units, -1)
        update_snapshot(spark, after, products_dir, PRODUCT_KEYS, {"batch_id": batch_id, "stream": stream}, base=meta)
        return True

    done = _until_committed(attempt)
    _tidy(spark, products_dir, PRODUCTS)
    return done


def batch_writer(products_dir: str, ledger_dir: str, stream: str = STOCK) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        apply_command_batch(batch.sparkSession, batch, batch_id, products_dir, ledger_dir, stream)

    return run


def start_command_stream(
    spark: SparkSession,
    source_dir: str,
    products_dir: str,
    ledger_dir: str,
    checkpoint_dir: str,
    available_now: bool = False,
    max_files_per_trigger: int | None = None,
    stream: str = STOCK,
) -> StreamingQuery:
    """Start the ingest stream (``available_now`` processes what is there and stops).

    ``stream`` names it among the streams that write the same tables.
    """
    reader = spark.readStream.schema(COMMANDS).option("recursiveFileLookup", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    writer = (
        reader.parquet(source_dir)
        .writeStream.foreachBatch(batch_writer(products_dir, ledger_dir, stream))
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


# ---------------------------------------------------------------- credit (M7)

CREDIT_COMMANDS = StructType(
    [
        StructField("transaction_type", StringType(), False),  # 'debt' | 'payment'
        StructField("shop_id", LongType(), False),
        StructField("id", LongType(), False),
        StructField("customer_id", LongType(), True),
        StructField("amount", DecimalType(14, 3), True),  # as given; the ledger rounds
        StructField("transaction_date", DateType(), True),
    ]
)
NAMED_DEBTS = StructType(
    [
        StructField("shop_id", LongType(), False),
        StructField("seq", LongType(), False),
        StructField("customer_name", StringType(), True),
        StructField("phone", StringType(), True),
        StructField("amount", DoubleType(), True),
        StructField("note", StringType(), True),
        StructField("command_date", DateType(), True),
    ]
)
BALANCES = StructType(
    [
        StructField("shop_id", LongType(), False),
        StructField("customer_id", LongType(), False),
        StructField("balance", DecimalType(20, 2), True),  # a sum, wider than one amount
    ]
)


def _add_to_balances(opening: DataFrame, rows: DataFrame) -> DataFrame:
    """The balances after the accepted ledger ``rows``; customers without rows keep theirs."""
    signed = L.signed_amount(F.col("amount"), F.col("transaction_type"))
    delta = rows.groupBy("shop_id", "customer_id").agg(F.sum(signed).alias("_delta"))
    zero = F.lit(0).cast("decimal(20,2)")
    total = F.coalesce(F.col("balance"), zero) + F.coalesce(F.col("_delta"), zero)
    j = opening.join(delta, ["shop_id", "customer_id"], "full")
    return j.select("shop_id", "customer_id", total.cast("decimal(20,2)").alias("balance"))


def _batch_rows(spark: SparkSession, ledger_dir: str, stream: str, batch_id: int) -> DataFrame:
    """The accepted debt rows of one batch, read back from storage."""
    path = f"{ledger_dir.rstrip('/')}/debt_transactions"
    schema = StructType(DEBTS.fields + [StructField("batch", StringType(), True)])
    rows = spark.read.schema(schema).parquet(path)
    return rows.where(F.col("batch") == batch_folder(batch_id, stream)).drop("batch")


def _post(spark: SparkSession, rows: DataFrame, balances_dir: str, stream: str, batch_id: int, meta: dict | None) -> None:
    """Commit the balances of the customers that have rows in a batch."""
    keys = rows.select(*BALANCE_KEYS).distinct()
    opening = read_snapshot(spark, balances_dir, BALANCES, meta, keys).join(keys, BALANCE_KEYS, "left_semi")
    after = _add_to_balances(opening, rows)
    update_snapshot(spark, after, balances_dir, BALANCE_KEYS, {"batch_id": batch_id, "stream": stream}, base=meta)


def apply_credit_batch(
    spark: SparkSession, cmds: DataFrame, batch_id: int, customers_dir: str, balances_dir: str, ledger_dir: str,
    stream: str = CREDIT,
) -> bool:
    """Apply one batch of debts and payments; ``False`` when already applied.

    Accepted rows go to the ledger, rejected ones apart; the balance change is
    summed from the batch's outcomes read back from storage and committed as a
    new balance version with the batch id.
    """
    name = "debt_transactions"

    def attempt() -> bool:
        meta = snapshot_meta(spark, balances_dir)
        if applied(meta, stream, batch_id):
            return False
        customers = read_snapshot(spark, customers_dir, CUSTOMERS)
        opening = read_snapshot(spark, balances_dir, BALANCES, meta, cmds.select(*BALANCE_KEYS).distinct())
        outcomes = _outcomes(L.apply_payments(customers, cmds, opening), ledger_dir, name, stream, batch_id)
        rows = outcomes.where(F.col("status") == L.ACCEPTED).withColumn("amount", F.col("amount").cast(MONEY))
        _accept(rows, ledger_dir, name, stream, batch_id)
        _reject(outcomes.where(F.col("status") != L.ACCEPTED), ledger_dir, name, stream, batch_id)
        _post(spark, rows, balances_dir, stream, batch_id, meta)
        return True

    done = _until_committed(attempt)
    _tidy(spark, balances_dir, BALANCES)
    return done


def apply_named_debts(
    spark: SparkSession, cmds: DataFrame, batch_id: int, customers_dir: str, balances_dir: str, ledger_dir: str,
    stream: str = NAMED,
) -> bool:
    """M5 as a stream: new debts by customer name; unknown names become customers.

    The ledger rows come first, then the customers, then the balances;
    each commit records the stream's batch id, and a replay resumes at the first that
    does not have it.  ``False`` when all of them do.
    """

    def name_customers() -> bool:
        known = snapshot_meta(spark, customers_dir)
        if applied(known, stream, batch_id):
            return False
        customers = read_snapshot(spark, customers_dir, CUSTOMERS, known)
        outcomes = _outcomes(L.apply_debts(customers, cmds), ledger_dir, "named_debts", stream, batch_id)
        _accept(outcomes.where(F.col("status") == L.ACCEPTED), ledger_dir, "debt_transactions", stream, batch_id)
        _reject(outcomes.where(F.col("status") != L.ACCEPTED), ledger_dir, "named_debts", stream, batch_id)
        after = L.upsert_customers(customers, cmds)
        same = [after[c].eqNullSafe(customers[c]) for c in CUSTOMERS.names]
        changed = after.join(customers, same, "left_anti")
        update_snapshot(spark, changed, customers_dir, CUSTOMER_KEYS, {"batch_id": batch_id, "stream": stream}, base=known)
        return True

    def post_balances() -> bool:
        owed = snapshot_meta(spark, balances_dir)
        if applied(owed, stream, batch_id):
            return False
        _post(spark, _batch_rows(spark, ledger_dir, stream, batch_id), balances_dir, stream, batch_id, owed)
        return True

    named = _until_committed(name_customers)
    posted = _until_committed(post_balances)
    _tidy(spark, customers_dir, CUSTOMERS)
    _tidy(spark, balances_dir, BALANCES)
    return named or posted


def start_named_debt_stream(
    spark: SparkSession, source_dir: str, customers_dir: str, balances_dir: str, ledger_dir: str, checkpoint_dir: str,
    available_now: bool = False, stream: str = NAMED,
) -> StreamingQuery:
    """Start the ingest stream of new debts by name."""

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_named_debts(batch.sparkSession, batch, batch_id, customers_dir, balances_dir, ledger_dir, stream)

    writer = (
        spark.readStream.schema(NAMED_DEBTS)
        .option("recursiveFileLookup", "true")
        .parquet(source_dir)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_credit_stream(
    spark: SparkSession,
    source_dir: str,
    customers_dir: str,
    balances_dir: str,
    ledger_dir: str,
    checkpoint_dir: str,
    available_now: bool = False,
    stream: str = CREDIT,
) -> StreamingQuery:
    """Start the debt/payment ingest stream."""

    def run(batch: DataFrame, batch_id: int) -> None:
        apply_credit_batch(batch.sparkSession, batch, batch_id, customers_dir, balances_dir, ledger_dir, stream)

    writer = (
        spark.readStream.schema(CREDIT_COMMANDS)
        .option("recursiveFileLookup", "true")
        .parquet(source_dir)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
