"""Positions of rows in an order, and connected groups, without a window over a whole shop or table.

Both write what they work on to the shared folder once, because each needs the same rows twice.
Flags by position go back to rows that were written, without dealing these out again (``marked``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, packed well, and read back."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str], name: str, groups: Sequence[str] = ()) -> DataFrame:
    """``df`` with the position of each row, from 1, in ``order`` (ascending, nulls first) within its group.

    Rows are range-partitioned by group and order and written as they lie, so a group of any size
    is spread over partitions.  A position is the row's place in its partition, plus the rows
    that the group has in the partitions before: one number a group and partition.
    """
    by = [*groups, *order]
    at, part, first, before = "_at", "_part", "_first", "_before"
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    rows = stored(placed, "numbered").withColumn(part, F.shiftright(at, 33))
    sizes = rows.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias(first))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn(before, F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    names = [*groups, part]
    sizes = sizes.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(names)], first, before)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(names)])
    position = (F.col(before) + F.col(at) - F.col(first) + 1).cast("long")
    return rows.join(sizes, same).select(*df.columns, position.alias(name))


BLOCK_BITS = 15  # a bitmap stands for 2 ** 15 positions
FEW_BLOCKS = 16384  # bitmaps (of 4 kB each) that every task may hold


def marked(df: DataFrame, at: str, hits: DataFrame, *names: str) -> DataFrame:
    """``df`` with the flags ``names`` of ``hits`` (``at``, flags) by position; a position that ``hits`` lacks has none set.

    The set positions travel as bitmaps.  Where ``df`` has few of them, it is read where it lies and not dealt out.
    """
    block, bit = F.shiftright(at, BLOCK_BITS), F.col(at).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))
    few = df.select(block.alias("_block")).distinct().limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS
    bits = hits.select(block.alias("_block"), bit.alias("_bit"), *names).repartition("_block").groupBy("_block")
    bits = bits.agg(*[F.expr(f"bitmap_construct_agg(_bit) FILTER (WHERE {name})").alias(f"_bits_{name}") for name in names])
    out = df.withColumns({"_block": block, "_bit": bit}).join(F.broadcast(bits) if few else bits, "_block", "left")
    for name in names:
        byte = F.expr(f"cast(conv(hex(substring(_bits_{name}, cast(_bit div 8 + 1 as int), 1)), 16, 10) as int)")
        flag = byte.bitwiseAND(F.expr("shiftleft(1, cast(_bit % 8 as int))")) != 0
        out = out.withColumn(name, F.coalesce(flag, F.lit(False)))
    return out.select(*df.columns, *names)


def connected(links: DataFrame) -> DataFrame:
    """The group of every node of the long columns (a, b), as (node, group): the smallest node it is connected with.

    Each round gives a node the smallest label among its neighbours and then that label's own label, which
    doubles the distance labels travel; it ends with the first round that changes nothing.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    now = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("group")).withColumnRenamed("a", "node"), "groups")
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("near"))
        own = now.join(near, F.col("node") == F.col("a")).select("node", F.col("group").alias("old"), F.least("group", "near").alias("group"))
        labels = now.select(F.col("node").alias("label"), F.col("group").alias("further"))
        then = own.join(labels, F.col("group") == F.col("label")).select("node", "old", F.least("group", "further").alias("group"))
        then = stored(then, "groups")
        changed = not then.where("old <> group").isEmpty()
        now = then.select("node", "group")
        if not changed:
            return now
