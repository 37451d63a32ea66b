"""SparkSession construction and shared-folder helpers.

Library code never creates a session on its own; callers (tests, bench,
the driver) pass one in.  ``build_session`` is a convenience for local runs
that sets the options every plan in this package assumes: ANSI mode (the
4.x default), UTC session time zone, adaptive execution with skew-join
handling, and no web UI.  A master or partition count given by spark-submit
(or in the environment's Spark configuration) wins over the local defaults.
"""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
PACKAGE_ROOT = str(Path(__file__).resolve().parents[1])


def build_session(
    master: str | None = None,
    app_name: str = "tallyspark",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    given = SparkConf()
    master = master or given.get("spark.master", None) or f"local[{cpus}]"
    parts = shuffle_partitions or given.get("spark.sql.shuffle.partitions", None)
    if parts is None and master.startswith("local["):
        parts = cpus if cpus.isdigit() else 8
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
    )
    if parts is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(parts))
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster where that folder is not shared, install the package on the
    executors or submit it with ``--py-files``.
    """
    workers = spark.sparkContext.environment
    paths = [p for p in workers.get("PYTHONPATH", "").split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        workers["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def is_machine_local(path: str) -> bool:
    """True for a path that names the local file system of whichever machine opens it."""
    return path.startswith(("file:", "/")) or "://" not in path


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` is used as it is set.  Where it is unset, a
    folder below the session's SQL warehouse takes its place; that is refused
    when the session runs on a cluster and the warehouse is machine-local,
    because executors would each write to a disk of their own.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None)
    if not current:
        current = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        master = spark.sparkContext.master
        if not master.split("[")[0] == "local" and is_machine_local(current):
            raise ValueError(
                f"set spark.checkpoint.dir to a folder that all executors share; {current} is local to each machine"
            )
        spark.conf.set(CHECKPOINT_CONF, current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
