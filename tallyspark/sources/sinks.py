"""Sinks: CSV export (S9) and versioned snapshot tables.

Snapshots are never overwritten in place: each batch writes a new folder and then
commits it by creating the next numbered pointer (a one-row JSON table, the version's
manifest), so a failed job leaves the previous version intact and readers
never see half a table.  A version is a base (a whole folder, or one folder for each hash
bucket of the keys) and a list of deltas, folders of changed rows: a batch writes what it
changes, compaction rewrites the buckets that deltas touch.  The manifest also holds the last
batch of every stream that writes the table.  Everything goes through the DataFrame reader and
writer (only ``remove_old_versions`` deletes through the file system); all folders live under
shared storage (the cluster's ``spark.checkpoint.dir`` by default), never on an executor's local disk.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

CSV_OPTIONS = {
    "header": "true",
    "emptyValue": "",
    "escape": '"',
    "encoding": "UTF-8",
    "dateFormat": "yyyy-MM-dd",
}


def write_csv(df: DataFrame, path: str) -> str:
    """Header, no index, empty text as nothing, quotes doubled (pandas style)."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.options(**CSV_OPTIONS).schema(schema).csv(path)


def batch_folder(batch_id: int, stream: str | None = None) -> str:
    """The folder name of a batch: streams number their batches each on its own."""
    return str(batch_id) if stream is None else f"{stream}-{batch_id}"


SHOP_BUCKET = "shop_bucket"


def shop_bucket(shop: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(shop), F.lit(buckets)).cast("int")


def write_ledger(
    df: DataFrame, path: str, date_col: str, batch_id: int | None = None, stream: str | None = None,
    shop_buckets: int | None = None,
) -> None:
    """Append ledger rows partitioned by month of ``date_col`` and batch.

    With a ``batch_id`` the write replaces that batch's own folders only (those of the
    ``stream``, where several write one ledger), so a replayed batch never duplicates rows;
    without one, rows are appended.

    Month (not shop) partitioning keeps the folder count bounded however many
    shops exist.  Rows are range-partitioned on (month, shop, date, id): a
    busy month or shop is cut into many tasks (the id makes every boundary
    splittable), each task writes a few files of one month, and rows are
    clustered by shop and date inside each file so min/max statistics prune
    by ``shop_id`` and date.  With ``shop_buckets``, folders are by hash bucket of the shop first, so
    that a join on the bucket (``tenant.stored_rows_for_caller``) prunes folders at run time.
    """
    rows = df.withColumn("month", F.date_format(F.col(date_col), "yyyy-MM")).withColumn(
        "batch", F.lit("load" if batch_id is None else batch_folder(batch_id, stream))
    )
    folders = ["month"]
    if shop_buckets:
        rows, folders = rows.withColumn(SHOP_BUCKET, shop_bucket("shop_id", shop_buckets)), [SHOP_BUCKET, "month"]
    by = [*folders, "shop_id", date_col, "id"]
    writer = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.partitionBy(*folders, "batch")
    if batch_id is None:
        writer.mode("append").parquet(path)
    else:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def drop_batch(spark: SparkSession, path: str, batch_id: int, stream: str | None = None) -> None:
    """Remove what an attempt at a batch that was never committed has left in a ledger."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = hadoop.Path(f"{path.rstrip('/')}/month=*/batch={batch_folder(batch_id, stream)}")
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for at in store.globStatus(found) or []:
        store.delete(at.getPath(), True)


def read_ledger(
    spark: SparkSession,
    path: str,
    schema: StructType,
    date_col: str,
    start: date | None = None,
    end: date | None = None,
    shop_buckets: bool = False,
) -> DataFrame:
    """Read a ledger written by ``write_ledger``, optionally for ``start..end``; with ``shop_buckets`` (if
    it was written with them) the rows' bucket folder is a column.

    Spark does not derive the ``month`` folder bounds from a date predicate,
    so the month range is added explicitly: a 7-day report lists and reads
    one or two month folders, not the whole history.  The date predicate
    itself is also pushed into the files' min/max statistics.
    """
    folders = [StructField("month", StringType(), True), StructField("batch", StringType(), True)]
    if shop_buckets:
        folders.append(StructField(SHOP_BUCKET, IntegerType(), True))
    try:
        df = spark.read.schema(StructType(schema.fields + folders)).parquet(path)
    except AnalysisException:  # nothing written yet
        return spark.createDataFrame([], schema)
    if start is not None:
        df = df.where((F.col("month") >= F.lit(start.strftime("%Y-%m"))) & (F.col(date_col) >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("month") <= F.lit(end.strftime("%Y-%m"))) & (F.col(date_col) <= F.lit(end)))
    return df.drop("month", "batch")


LATEST = object()
POINTERS = "_pointers"
POINTER = StructType(
    [
        StructField("seq", LongType(), False),
        StructField("version", StringType(), False),
        StructField("batch_id", LongType(), True),
        StructField("batches", MapType(StringType(), LongType()), True),  # stream -> last batch it has committed
        StructField("buckets", IntegerType(), True),
        StructField("keys", ArrayType(StringType()), True),
        StructField("base", MapType(StringType(), StringType()), True),  # bucket -> folder; null: all of ``version``
        StructField("deltas", ArrayType(StringType()), True),  # folders of changed rows, oldest first
        StructField("committed_at", TimestampType(), True),
    ]
)
BUCKETS = 256
MAX_DELTAS = 8
GONE, BUCKET = "_gone", "_bucket"


class CommitConflict(RuntimeError):
    """Another writer has committed since the version that this commit is based on."""


_committing = threading.Lock()  # streams of one application commit one after the other


def _pointers(spark: SparkSession, table_dir: str) -> list[dict]:
    try:
        rows = spark.read.schema(POINTER).json(f"{table_dir.rstrip('/')}/{POINTERS}/*").collect()  # one row a version
    except AnalysisException:  # nothing committed yet
        return []
    return sorted((r.asDict() for r in rows), key=lambda r: r["seq"])


def snapshot_meta(spark: SparkSession, table_dir: str, seq: int | None = None) -> dict | None:
    """The manifest of the current version (or of version ``seq``), or ``None``.

    Each commit is a one-row JSON table under ``_pointers/<seq>``; the highest
    sequence number is current.  A commit only ever *creates* a pointer, and
    a pointer being written shows no data file until its job commits, so a
    reader sees the old or the new version, never neither.
    """
    found = [m for m in _pointers(spark, table_dir) if seq is None or m["seq"] == seq]
    return found[-1] if found else None


def applied(meta: dict | None, stream: str, batch_id: int) -> bool:
    """True when the version already holds batch ``batch_id`` of ``stream``."""
    return meta is not None and (meta["batches"] or {}).get(stream, -1) >= batch_id


def current_version(spark: SparkSession, table_dir: str) -> str | None:
    meta = snapshot_meta(spark, table_dir)
    return None if meta is None else meta["version"]


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def read_snapshot(
    spark: SparkSession, table_dir: str, schema: StructType, meta: dict | None | object = LATEST, only: DataFrame | None = None
) -> DataFrame:
    """The rows of a snapshot table (empty when none was written), of the current version or of ``meta``.

    Rows of the bucketed base that a delta changes are left out by an anti-join with the (small) deltas.
    ``only`` holds key columns: just the buckets of those keys are read, and all rows of these
    buckets are returned.  Folders of a version never change, so a read sees one version, whatever is
    committed or compacted meanwhile.
    """
    meta = snapshot_meta(spark, table_dir) if meta is LATEST else meta
    if meta is None:
        return spark.createDataFrame([], schema)
    table, deltas = table_dir.rstrip("/"), meta["deltas"] or []
    wanted = None
    if only is not None and meta["keys"]:
        found = only.select(_bucket(meta["keys"], meta["buckets"]).alias(BUCKET)).distinct().collect()  # at most ``buckets``
        wanted = sorted(r[0] for r in found)
    if meta["base"] is None:
        base = spark.read.schema(schema).parquet(f"{table}/{meta['version']}")
        base = base if wanted is None else base.where(_bucket(meta["keys"], meta["buckets"]).isin(wanted))
    else:
        at = {int(b): f for b, f in meta["base"].items()}
        paths = [f"{table}/{at[b]}/{BUCKET}={b}" for b in (at if wanted is None else wanted) if b in at]
        base = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    if not deltas:
        return base
    keys = meta["keys"]
    changed = _changed(spark, table, schema, meta, wanted)
    names = [f.name for f in schema.fields]
    return base.join(changed.select(*keys), keys, "left_anti").select(*names).unionByName(changed.where(~F.col(GONE)).select(*names))


def _changed(spark: SparkSession, table: str, schema: StructType, meta: dict, wanted: list[int] | None = None) -> DataFrame:
    """The last state of every key that a delta changes, with its bucket."""
    extra = [StructField(GONE, BooleanType(), False), StructField(BUCKET, IntegerType(), False)]
    parts = [
        spark.read.schema(StructType(schema.fields + extra)).parquet(f"{table}/{d}").withColumn("_nth", F.lit(n))
        for n, d in enumerate(meta["deltas"])
    ]
    rows = reduce(DataFrame.unionByName, parts)
    if wanted is not None:
        rows = rows.where(F.col(BUCKET).isin(wanted))
    if len(parts) == 1:
        return rows.drop("_nth")
    others = [c for c in rows.columns if c not in (*meta["keys"], "_nth")]
    last = rows.groupBy(*meta["keys"]).agg(F.max_by(F.struct(*others), "_nth").alias("_last"))
    return last.select(*meta["keys"], "_last.*").select(*[c for c in rows.columns if c != "_nth"])


def _commit(spark: SparkSession, table: str, prev: dict | None, meta: dict | None, version: str, **layout) -> dict:
    """Create the pointer after ``prev``; raises ``CommitConflict`` where another commit has taken its place."""
    meta, seq = meta or {}, 1 if prev is None else int(prev["seq"]) + 1
    batch_id, stream = meta.get("batch_id"), meta.get("stream")
    batches = dict((prev or {}).get("batches") or {})
    if stream is not None:
        batches[stream] = int(batch_id)
    row = {f.name: None for f in POINTER.fields} | layout
    row |= {
        "seq": seq, "version": version, "batch_id": None if batch_id is None else int(batch_id), "batches": batches,
        "committed_at": datetime.now(timezone.utc),
    }
    pointer = spark.createDataFrame([tuple(row[f.name] for f in POINTER.fields)], POINTER).coalesce(1)
    with _committing:
        path = f"{table}/{POINTERS}/{seq:020d}"
        try:
            pointer.write.mode("error").json(path)
        except AnalysisException as taken:
            if any(m["seq"] >= seq for m in _pointers(spark, table)):
                raise CommitConflict(str(taken)) from taken
            pointer.write.mode("overwrite").json(path)  # a folder without a pointer: its writer died
    return row


def write_snapshot(
    spark: SparkSession, df: DataFrame, table_dir: str, meta: dict | None = None, base: dict | None | object = LATEST
) -> str:
    """Write ``df`` as a new version folder, then commit it with a new pointer.

    ``meta`` may hold ``batch_id`` and the ``stream`` that the batch belongs to: each
    stream's last batch is kept apart in the manifest, so several streams share a table.
    ``base`` is the ``snapshot_meta`` that ``df`` was computed from (``None``: no
    version yet).  The commit takes the sequence number after it and is written
    with ``mode("error")``: if another writer has committed since that base, this
    commit raises ``CommitConflict`` instead of losing the other's update.  Without ``base`` the
    write is a replacement, whatever the current version is.
    """
    table = table_dir.rstrip("/")
    prev = snapshot_meta(spark, table) if base is LATEST else base
    version = f"v-{uuid.uuid4().hex}"
    df.write.mode("error").parquet(f"{table}/{version}")
    _commit(spark, table, prev, meta, version)
    return version


def update_snapshot(
    spark: SparkSession, changed: DataFrame, table_dir: str, keys: list[str], meta: dict | None = None,
    base: dict | None | object = LATEST, gone: Column | None = None, buckets: int = BUCKETS,
) -> dict:
    """Commit a new version that differs from ``base`` in the rows of ``changed`` only.

    ``changed`` holds one whole row for every key that is new or has changed; where ``gone`` is
    true the key is deleted.  Only these rows are written, as a delta; what was
    there stays where it is.  ``compact_snapshot`` folds deltas into the buckets they touch.
    """
    table = table_dir.rstrip("/")
    prev = snapshot_meta(spark, table) if base is LATEST else base
    buckets = prev["buckets"] if prev and prev["buckets"] else buckets
    delta = changed.withColumn(GONE, F.lit(False) if gone is None else F.coalesce(gone, F.lit(False)))
    delta, folder = delta.withColumn(BUCKET, _bucket(keys, buckets)), f"v-{uuid.uuid4().hex}"
    delta.repartitionByRange(BUCKET, *keys).sortWithinPartitions(BUCKET).write.mode("error").parquet(f"{table}/{folder}")
    version, layout = folder, {"base": {}, "deltas": [folder]}
    if prev is not None:
        version, layout = prev["version"], {"base": prev["base"], "deltas": [*(prev["deltas"] or []), folder]}
    return _commit(spark, table, prev, meta, version, keys=keys, buckets=buckets, **layout)


def compact_snapshot(spark: SparkSession, table_dir: str, schema: StructType, max_deltas: int = 0) -> dict | None:
    """Fold the deltas of a table with over ``max_deltas`` of them into its base; the rows stay the same.

    Only buckets that a delta touches are rewritten (all of them where the base is not cut into
    buckets yet).  Readers and writers go on meanwhile; if one commits first, ``CommitConflict`` is raised.
    """
    table, prev = table_dir.rstrip("/"), snapshot_meta(spark, table_dir)
    if prev is None or len(prev["deltas"] or []) <= max_deltas:
        return prev
    keys, buckets = prev["keys"], prev["buckets"]
    touched = None
    if prev["base"] is not None:
        touched = _changed(spark, table, schema, prev).select(*keys).distinct()
    rows = read_snapshot(spark, table, schema, prev, touched)
    cut, version = rows.withColumn(BUCKET, _bucket(keys, buckets)), f"v-{uuid.uuid4().hex}"
    if touched is not None:
        hit = [r[0] for r in touched.select(_bucket(keys, buckets)).distinct().collect()]  # at most ``buckets``
        cut = cut.where(F.col(BUCKET).isin(hit))
    cut.repartition(BUCKET).write.partitionBy(BUCKET).mode("error").parquet(f"{table}/{version}")
    written = spark.read.schema(StructType(schema.fields + [StructField(BUCKET, IntegerType())])).parquet(f"{table}/{version}")
    base = {} if touched is None else {b: f for b, f in prev["base"].items() if int(b) not in hit}
    base |= {str(r[0]): version for r in written.select(BUCKET).distinct().collect()}
    return _commit(spark, table, prev, None, version, keys=keys, buckets=buckets, base=base, deltas=[])


def write_buckets(
    spark: SparkSession, df: DataFrame, table_dir: str, keys: list[str], order: list[str], buckets: int = BUCKETS
) -> dict:
    """Write ``df`` as a new version cut into the hash buckets of ``keys`` (for a ledger: the shop), then commit it.

    Rows are range-partitioned by bucket and ``order``, so a bucket with a hot shop is cut into many files.
    """
    table, prev = table_dir.rstrip("/"), snapshot_meta(spark, table_dir)
    schema, version = df.schema, f"v-{uuid.uuid4().hex}"
    base = _write_cut(spark, df, schema, table, version, keys, buckets, order)
    return _commit(spark, table, prev, None, version, keys=keys, buckets=buckets, base=base, deltas=[])


def _write_cut(spark, df, schema, table, version, keys, buckets, order, placed: bool = False) -> dict[str, str]:
    cut = df.withColumn(BUCKET, _bucket(keys, buckets))
    cut = (cut if placed else cut.repartitionByRange(BUCKET, *order)).sortWithinPartitions(BUCKET, *order)
    cut.write.partitionBy(BUCKET).mode("error").parquet(f"{table}/{version}")
    written = spark.read.schema(StructType(schema.fields + [StructField(BUCKET, IntegerType())])).parquet(f"{table}/{version}")
    return {str(r[0]): version for r in written.select(BUCKET).distinct().collect()}  # at most ``buckets``


def rewrite_buckets(
    spark: SparkSession, table_dir: str, schema: StructType, touched: DataFrame, change: Callable[[DataFrame], DataFrame],
    order: list[str], placed: bool = False,
) -> dict:
    """Commit a version in which the buckets of the keys in ``touched`` hold ``change`` of their rows.

    The other buckets stay where they are.  With ``placed``, ``change`` leaves the rows in their partitions, and they
    are written as they were read, without a shuffle.  Raises ``CommitConflict`` if another writer commits first.
    """
    table, prev = table_dir.rstrip("/"), snapshot_meta(spark, table_dir)
    keys, buckets = prev["keys"], prev["buckets"]
    hit = [r[0] for r in touched.select(_bucket(keys, buckets)).distinct().collect()]  # at most ``buckets``
    rows = read_snapshot(spark, table, schema, prev, touched)
    version = f"v-{uuid.uuid4().hex}"
    base = {b: f for b, f in prev["base"].items() if int(b) not in hit}
    if hit:
        base |= _write_cut(spark, change(rows), schema, table, version, keys, buckets, order, placed)
    return _commit(spark, table, prev, None, version, keys=keys, buckets=buckets, base=base, deltas=[])


def _folders(meta: dict) -> set[str]:
    whole = [meta["version"]] if meta["base"] is None else meta["base"].values()
    return {*whole, *(meta["deltas"] or [])}


def remove_old_versions(spark: SparkSession, table_dir: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions: their pointers first, then the folders that no kept version reads.

    Folders that no removed version names are left alone: a writer may not have committed them yet.
    Versions a reader still uses must be among those kept.
    """
    table, versions = table_dir.rstrip("/"), _pointers(spark, table_dir)
    old, kept = versions[:-keep], versions[-keep:]
    unused = set().union(*map(_folders, old)) - set().union(*map(_folders, kept)) if old else set()
    names = [f"{POINTERS}/{m['seq']:020d}" for m in old] + sorted(unused)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for name in names:
        path = hadoop.Path(f"{table}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return names


# Ledger tables are append-only and partitioned by month; the rest are snapshots.
LEDGER_DATE = {"sales": "sale_date", "debt_transactions": "transaction_date", "restocks": "restock_date"}


def table_schemas() -> dict[str, StructType]:
    from .. import schemas as S

    return {
        "shops": S.SHOPS,
        "profiles": S.PROFILES,
        "products": S.PRODUCTS,
        "customers": S.CUSTOMERS,
        "sales": S.SALES,
        "debt_transactions": S.DEBTS,
        "restocks": S.RESTOCKS,
    }


def read_table(spark: SparkSession, root: str, name: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """The current rows of a table made by ``create_tables`` (a ledger optionally for ``start..end``)."""
    table, schema = f"{root.rstrip('/')}/{name}", table_schemas()[name]
    if name not in LEDGER_DATE:
        return read_snapshot(spark, table, schema)
    version = current_version(spark, table)
    if version is None:
        return spark.createDataFrame([], schema)
    return read_ledger(spark, f"{table}/{version}", schema, LEDGER_DATE[name], start, end)


def append_rows(
    spark: SparkSession, root: str, name: str, rows: DataFrame, batch_id: int | None = None, stream: str | None = None
) -> None:
    """S12 on a table made by ``create_tables``: ledger rows into the current version."""
    table = f"{root.rstrip('/')}/{name}"
    write_ledger(_typed(rows, name), f"{table}/{current_version(spark, table)}", LEDGER_DATE[name], batch_id, stream)


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType) for f in table_schemas()[name].fields])


def create_tables(spark: SparkSession, root: str) -> None:
    """Every table with its declared schema, empty, as a first committed version
    (existing tables are left alone, like CREATE TABLE IF NOT EXISTS)."""
    for name, schema in table_schemas().items():
        if current_version(spark, f"{root.rstrip('/')}/{name}") is None:
            reset_tables(spark, root, {name: spark.createDataFrame([], schema)})


def reset_tables(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> None:
    """Replace the named tables wholesale (demo reset and reload).

    Each table is written as a new version and committed by its pointer, so a
    failed reload leaves the former rows in place.
    """
    for name, df in tables.items():
        table, rows = f"{root.rstrip('/')}/{name}", _typed(df, name)
        if name not in LEDGER_DATE:
            write_snapshot(spark, rows, table)
            continue
        prev, version = snapshot_meta(spark, table), f"v-{uuid.uuid4().hex}"
        write_ledger(rows, f"{table}/{version}", LEDGER_DATE[name])
        _commit(spark, table, prev, None, version)
