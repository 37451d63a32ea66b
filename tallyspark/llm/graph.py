"""Connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a, b) edges as (node, root), root the smallest node of its component.

    Alternates large-star and small-star steps; every step keeps the number of
    edges at most, each round is written to the shared folder, and the loop
    ends when a round changes nothing.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = store(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct(), "cc")
    mark = None
    while True:
        digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = digest
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = store(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
