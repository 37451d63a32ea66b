"""ST1 with the levels in the state store: stock and balances carried by ``transformWithState``.

The micro-batch streams of ``ingest`` keep the levels in a snapshot table.  Here the state
store keeps them: one value a product (units in stock, buy price, name, sell price)
or a customer (cents owed, name), loaded once from an opening snapshot and checkpointed by Spark.
A trigger reads and writes only the keys it has commands for, and the sink only
appends ledger rows.  ``levels`` reads the state back as a table.

Commands are applied in the order (date, id, restocks first) within a trigger and in the order of
arrival between triggers, by the same rules as the batch operators (M4, M6, M7, M9); what a key
gets in one trigger is sorted in memory, so ``max_files_per_trigger`` bounds it.
Commands without a key are rejected one by one, spread by their id.

The session needs the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass`` = ``ROCKSDB``), as ``transformWithState`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.expr import WHITE_SPACE
from ..operators.fold import ADD, SKIP, TAKE, replay
from ..operators.ledger import ACCEPTED, LEDGER_TYPES, PAYMENT_NOTE, REJECTED
from ..sources.sinks import LEDGER_DATE, drop_batch, table_schemas, write_ledger
from .ingest import COMMANDS, CREDIT_COMMANDS, RESTOCK, SALE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEVEL = "level"  # name of the state variable

STOCK_STATE = "stock long, buy_cents long, sell_cents long, name string"
BALANCE_STATE = "owed long, name string"
STOCK_OUT = (
    "kind string, shop_id long, id string, product_id long, product_name string, quantity int, command_date date, "
    "supplier_name string, unit_buy_price decimal(12,2), update_buy_price boolean, status string, reason string, "
    "revenue decimal(18,2), profit decimal(18,2), level_after long"
)
CREDIT_OUT = (
    "shop_id long, id long, customer_id long, customer_name string, transaction_type string, amount decimal(12,2), "
    "note string, transaction_date date, status string, reason string, level_after long"
)


def _cents(amounts: pd.Series) -> pd.Series:
    """Decimal money as whole cents; null stays null."""
    return amounts.map(lambda x: None if x is None or x != x else int(x * 100))


def _joined(rules: list[tuple[pd.Series, str]]) -> list[str]:
    """The codes of all violated rules of each row."""
    flags = [r.to_numpy(dtype=bool) for r, _ in rules]
    return [";".join(code for (_, code), hit in zip(rules, hits) if hit) for hits in zip(*flags)]


class _Folder(StatefulProcessor):
    """One value of state a key; a trigger's commands of the key sorted and replayed from it."""

    state_schema: str
    order: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.level = handle.getValueState(LEVEL, self.state_schema)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.level.update(self.opening(initialState.iloc[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.level.exists():
            for some in rows:
                yield self.refused(some)
            return
        every = pd.concat(list(rows), ignore_index=True)
        every = every.sort_values(self.order, na_position="first", kind="stable", ignore_index=True)
        out, state = self.fold(every, self.level.get())
        self.level.update(state)
        yield out

    def close(self) -> None:
        pass


def _plain(x):
    return None if pd.isna(x) else x


class StockFolder(_Folder):
    """Sales and restocks of a product against its stock and buy price."""

    state_schema, order = STOCK_STATE, ["command_date", "id", "rank"]

    def opening(self, row) -> tuple:
        return int(row["stock"] or 0), _plain(row["buy_cents"]), _plain(row["sell_cents"]), row["name"]

    def refused(self, rows: pd.DataFrame) -> pd.DataFrame:
        reasons = self.reasons(rows, unknown=True)
        return self.rows(rows, None, np.zeros(len(rows), dtype=bool), reasons, None, None, None, None)

    @staticmethod
    def reasons(rows: pd.DataFrame, unknown: bool) -> list[str]:
        restock = rows["kind"] == RESTOCK
        price = rows["unit_buy_price"].map(lambda x: x is None or x != x or x < 0)
        blank = rows["supplier_name"].map(lambda x: not isinstance(x, str) or not x.strip(WHITE_SPACE))
        return _joined(
            [
                (~(rows["quantity"].fillna(0) > 0), "quantity_not_positive"),
                (restock & blank, "supplier_required"),
                (restock & price, "negative_price"),
                (pd.Series(unknown, rows.index), "product_not_found"),
            ]
        )

    @staticmethod
    def rows(rows, name, accepted, reasons, revenue, profit, after, stock) -> pd.DataFrame:
        money = lambda cents: None if cents is None else [None if c is None else _money(c) for c in cents]
        return pd.DataFrame(
            {
                "kind": rows["kind"], "shop_id": rows["shop_id"], "id": rows["id"], "product_id": rows["product_id"].astype("Int64"),
                "product_name": name, "quantity": rows["quantity"].astype("Int32"), "command_date": rows["command_date"],
                "supplier_name": rows["supplier_name"], "unit_buy_price": rows["unit_buy_price"],
                "update_buy_price": rows["update_buy_price"], "status": np.where(accepted, ACCEPTED, REJECTED), "reason": reasons,
                "revenue": money(revenue), "profit": money(profit), "level_after": pd.array(after, "Int64") if after is not None else None,
            }
        )

    def fold(self, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        stock, buy, sell, name = state
        reasons = self.reasons(rows, unknown=False)
        bad, sale = np.array([bool(r) for r in reasons]), (rows["kind"] == SALE).to_numpy()
        kinds = np.where(bad, SKIP, np.where(sale, TAKE, ADD))
        quantity = rows["quantity"].fillna(0).astype("int64").to_numpy()
        accepted, after = replay(kinds, quantity, stock)
        reasons = [r or ("" if ok else "insufficient_stock") for r, ok in zip(reasons, accepted)]
        revenue, profit = [], []
        prices = _cents(rows["unit_buy_price"])
        for ok, is_sale, n, price, sets in zip(accepted.tolist(), sale.tolist(), quantity.tolist(), prices, rows["update_buy_price"]):
            if ok and not is_sale and sets:
                buy = int(price)
            sold = ok and is_sale
            revenue.append(n * sell if sold and sell is not None else None)
            profit.append(n * (sell - buy) if sold and sell is not None and buy is not None else None)
        stock = int(after[-1])
        return self.rows(rows, name, accepted, reasons, revenue, profit, after, stock), (stock, buy, sell, name)


class BalanceFolder(_Folder):
    """Debts and payments of a customer against the balance owed."""

    state_schema, order = BALANCE_STATE, ["transaction_date", "id"]

    def opening(self, row) -> tuple:
        return int(row["owed"] or 0), row["name"]

    @staticmethod
    def reasons(rows: pd.DataFrame, unknown: bool) -> list[str]:
        return _joined(
            [
                (~rows["transaction_type"].isin(LEDGER_TYPES), "unknown_type"),
                (~(rows["cents"].fillna(0) > 0), "amount_not_positive"),
                (pd.Series(unknown, rows.index), "customer_not_found"),
            ]
        )

    @staticmethod
    def rows(rows, name, accepted, reasons, after) -> pd.DataFrame:
        pays = rows["transaction_type"] == "payment"
        return pd.DataFrame(
            {
                "shop_id": rows["shop_id"], "id": rows["id"], "customer_id": rows["customer_id"].astype("Int64"), "customer_name": name,
                "transaction_type": rows["transaction_type"], "amount": [None if pd.isna(c) else _money(int(c)) for c in rows["cents"]],
                "note": np.where(pays, PAYMENT_NOTE, None), "transaction_date": rows["transaction_date"],
                "status": np.where(accepted, ACCEPTED, REJECTED), "reason": reasons,
                "level_after": pd.array(after, "Int64") if after is not None else None,
            }
        )

    def refused(self, rows: pd.DataFrame) -> pd.DataFrame:
        return self.rows(rows, None, np.zeros(len(rows), dtype=bool), self.reasons(rows, unknown=True), None)

    def fold(self, rows: pd.DataFrame, state: tuple) -> tuple[pd.DataFrame, tuple]:
        owed, name = state
        reasons = self.reasons(rows, unknown=False)
        bad, pays = np.array([bool(r) for r in reasons]), (rows["transaction_type"] == "payment").to_numpy()
        kinds = np.where(bad, SKIP, np.where(pays, TAKE, ADD))
        cents, asked = (rows[c].fillna(0).astype("int64").to_numpy() for c in ("cents", "asked"))
        accepted, after = replay(kinds, cents, owed, np.maximum(asked - cents, 0))
        reasons = [r or ("" if ok else "exceeds_balance") for r, ok in zip(reasons, accepted)]
        return self.rows(rows, name, accepted, reasons, after), (int(after[-1]), name)


def _money(cents: int):
    from decimal import Decimal

    return Decimal(cents).scaleb(-2)


def _keyed(rows: DataFrame, key: str) -> DataFrame:
    """Rows without a key are spread by their id."""
    return rows.withColumn("salt", F.when(F.col("shop_id").isNull() | F.col(key).isNull(), F.xxhash64("id")).otherwise(F.lit(0)))


def stock_outcomes(commands: DataFrame, products: DataFrame) -> DataFrame:
    """The outcome of every command of a stream of ``COMMANDS``, from the stock of the ``products`` snapshot on."""
    cents = lambda c: (F.col(c) * 100).cast("long")
    opening = products.select(
        "shop_id", F.col("id").alias("product_id"), F.lit(0).cast("long").alias("salt"),
        F.coalesce("stock_quantity", F.lit(0)).cast("long").alias("stock"), cents("buy_price").alias("buy_cents"),
        cents("sell_price").alias("sell_cents"), "name",
    )
    rank = F.when(F.col("kind") == RESTOCK, 0).otherwise(1)
    rows = _keyed(commands.where(F.col("kind").isin(SALE, RESTOCK)).withColumn("rank", rank), "product_id")
    return _folded(rows, opening, ["shop_id", "product_id", "salt"], StockFolder(), STOCK_OUT)


def credit_outcomes(commands: DataFrame, customers: DataFrame, balances: DataFrame | None = None) -> DataFrame:
    """The outcome of every command of a stream of ``CREDIT_COMMANDS``, from the ``balances`` snapshot (absent: 0) on."""
    opening = customers.select("shop_id", F.col("id").alias("customer_id"), "name")
    if balances is None:
        opening = opening.withColumn("owed", F.lit(0).cast("long"))
    else:
        owed = balances.select("shop_id", "customer_id", (F.col("balance") * 100).cast("long").alias("owed"))
        opening = opening.join(owed, ["shop_id", "customer_id"], "left").withColumn("owed", F.coalesce("owed", F.lit(0).cast("long")))
    opening = opening.select("shop_id", "customer_id", F.lit(0).cast("long").alias("salt"), "owed", "name")
    rows = _keyed(commands, "customer_id").select(
        "shop_id", "customer_id", "salt", "id", "transaction_type", "transaction_date",
        (F.col("amount").cast("decimal(12,2)") * 100).cast("long").alias("cents"),
        F.ceil(F.col("amount") * 100).cast("long").alias("asked"),
    )
    return _folded(rows, opening, ["shop_id", "customer_id", "salt"], BalanceFolder(), CREDIT_OUT)


def _folded(rows: DataFrame, opening: DataFrame, keys: list[str], folder: _Folder, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(
        folder, schema, "Append", "None", initialState=opening.groupBy(*keys)
    )


def _append(rows: DataFrame, ledger_dir: str, name: str, batch_id: int, stream: str) -> None:
    typed = rows.select(*[F.col(f.name).cast(f.dataType) for f in table_schemas()[name].fields])
    path = f"{ledger_dir.rstrip('/')}/{name}"
    drop_batch(rows.sparkSession, path, batch_id, stream)
    write_ledger(typed, path, LEDGER_DATE[name], batch_id, stream)


def _start(outcomes: DataFrame, run: Callable[[DataFrame, int], None], checkpoint_dir: str, available_now: bool) -> StreamingQuery:
    writer = outcomes.writeStream.foreachBatch(run).outputMode("append").option("checkpointLocation", checkpoint_dir)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def _source(spark: SparkSession, schema: StructType, source_dir: str, max_files: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", str(max_files)) if max_files else reader).parquet(source_dir)


def start_stock_stream(
    spark: SparkSession, source_dir: str, products: DataFrame, ledger_dir: str, checkpoint_dir: str,
    available_now: bool = False, max_files_per_trigger: int | None = None, stream: str = "stock",
) -> StreamingQuery:
    """M4/M6/M9: accepted sales and restocks go to the ledgers, rejected commands to a folder of rejects.

    ``products`` is read when the stream starts for the first time; a restart goes on from the checkpoint.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        path = f"{ledger_dir.rstrip('/')}/outcomes/{stream}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.schema(STOCK_OUT).parquet(path)
        ok = F.col("status") == ACCEPTED
        _append(rows.where(ok & (F.col("kind") == SALE)).withColumn("sale_date", F.col("command_date")), ledger_dir, "sales", batch_id, stream)
        restocks = rows.where(ok & (F.col("kind") == RESTOCK)).select(
            "shop_id", "id", "product_id", "product_name", F.col("quantity").alias("quantity_added"),
            F.btrim("supplier_name", F.lit(WHITE_SPACE)).alias("supplier_name"), "unit_buy_price",
            F.col("command_date").alias("restock_date"), F.col("update_buy_price").alias("updated_buy_price"),
        )
        _append(restocks, ledger_dir, "restocks", batch_id, stream)
        rows.where(~ok).write.mode("overwrite").parquet(f"{ledger_dir.rstrip('/')}/rejects/{stream}/batch_id={batch_id}")

    outcomes = stock_outcomes(_source(spark, COMMANDS, source_dir, max_files_per_trigger), products)
    return _start(outcomes, run, checkpoint_dir, available_now)


def start_balance_stream(
    spark: SparkSession, source_dir: str, customers: DataFrame, balances: DataFrame | None, ledger_dir: str,
    checkpoint_dir: str, available_now: bool = False, max_files_per_trigger: int | None = None, stream: str = "credit",
) -> StreamingQuery:
    """M7: accepted debts and payments go to the ledger, rejected commands to a folder of rejects."""

    def run(batch: DataFrame, batch_id: int) -> None:
        path = f"{ledger_dir.rstrip('/')}/outcomes/{stream}/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(path)
        rows = batch.sparkSession.read.schema(CREDIT_OUT).parquet(path)
        ok = F.col("status") == ACCEPTED
        _append(rows.where(ok), ledger_dir, "debt_transactions", batch_id, stream)
        rows.where(~ok).write.mode("overwrite").parquet(f"{ledger_dir.rstrip('/')}/rejects/{stream}/batch_id={batch_id}")

    outcomes = credit_outcomes(_source(spark, CREDIT_COMMANDS, source_dir, max_files_per_trigger), customers, balances)
    return _start(outcomes, run, checkpoint_dir, available_now)


def levels(spark: SparkSession, checkpoint_dir: str) -> DataFrame:
    """The state of a stream after its last committed batch: key columns and state columns."""
    state = spark.read.format("statestore").option("stateVarName", LEVEL).load(checkpoint_dir)
    return state.select("key.*", "value.*").drop("salt")
