"""Explicit-schema reads of the driver's parquet tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..schemas import DRIVER


class DriverTables:
    """Lazy handles on ``{sf_dir}/{name}.parquet``.

    Reads use the declared schema (no inference, no footer sampling on the
    driver); Catalyst prunes columns and pushes filters into each scan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        reader = self.spark.read
        if name in DRIVER:
            reader = reader.schema(DRIVER[name])
        return reader.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def region(self) -> DataFrame:
        return self.table("region")

    @cached_property
    def nation(self) -> DataFrame:
        return self.table("nation")

    @cached_property
    def customer(self) -> DataFrame:
        return self.table("customer")

    @cached_property
    def supplier(self) -> DataFrame:
        return self.table("supplier")

    @cached_property
    def part(self) -> DataFrame:
        return self.table("part")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def conversations(self) -> DataFrame:
        return self.table("conversations")
