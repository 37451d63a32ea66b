"""Row time stamps: ``created_at`` once, ``updated_at`` whenever a command touches the row.

The batch operators return tables without stamps; ``restamp`` carries them from the
snapshot before a batch to the one after it.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, TimestampNTZType

STAMPS = [StructField("created_at", TimestampNTZType(), False), StructField("updated_at", TimestampNTZType(), False)]
CREATED, UPDATED = (f.name for f in STAMPS)


def first_stamps(rows: DataFrame, at: datetime) -> DataFrame:
    """Rows that are inserted at ``at`` (ledger rows have no ``updated_at`` to refresh, but the same meaning)."""
    now = F.lit(at).cast("timestamp_ntz")
    return rows.withColumns({CREATED: now, UPDATED: now})


def restamp(before: DataFrame, after: DataFrame, keys: list[str], touched: DataFrame, at: datetime) -> DataFrame:
    """``after`` (without stamps) with those of ``before``: rows whose key is new get both at ``at``; rows
    whose key is in ``touched`` keep ``created_at`` and are refreshed, though every value be as it was."""
    now = F.lit(at).cast("timestamp_ntz")
    old = before.select(*keys, F.col(CREATED).alias("_created"), F.col(UPDATED).alias("_updated"))
    hit = touched.select(*keys).distinct().withColumn("_touched", F.lit(True))
    j = after.join(old, keys, "left").join(hit, keys, "left")
    updated = F.when(F.col("_touched") | F.col("_updated").isNull(), now).otherwise(F.col("_updated"))
    return j.select(*after.columns, F.coalesce("_created", now).alias(CREATED), updated.alias(UPDATED))
