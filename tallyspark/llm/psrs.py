"""Exact ranks by parallel sorting by regular sampling.

1. Every partition sorts its rows and writes them: a sorted run.
2. Each run gives every n-th of its rows as a sample, with n = rows / ranges^2, so that
   the samples number about ranges^2 whatever the rows; every (samples / ranges)-th of
   the sorted samples is a splitter.
3. Rows go to the range between their splitters (one partition a range), where Spark
   merges what came from the runs.
4. The ranges' sizes are added up to offsets; a row's rank is its range's offset plus its
   place in the range.

Splitters and sizes are one number a range; samples are ``ranges``^2 rows, ``MAX_RANGES``^2
at most.  By regular sampling no range holds more than about twice its share: rows that
agree in all keys are told apart by a number each row gets when it is written, so a group
of equal rows is split like any other.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, unused

MAX_RANGES = 1000
LAST = np.iinfo(np.int64).max


def _keys(batch: pa.RecordBatch, names: Sequence[str]) -> list[np.ndarray]:
    """Key columns as integers, nulls last."""
    return [pc.fill_null(batch.column(n), int(LAST)).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _order(keys: Sequence[np.ndarray]) -> np.ndarray:
    return np.lexsort(tuple(reversed(keys)))


def _ranges(keys: list[np.ndarray], splitters: list[np.ndarray]) -> np.ndarray:
    """How many splitters are at or below each row."""
    rows, cuts = len(keys[0]), len(splitters[0])
    is_row = np.concatenate([np.zeros(cuts, dtype=np.int64), np.ones(rows, dtype=np.int64)])
    order = _order([*(np.concatenate([s, k]) for s, k in zip(splitters, keys)), is_row])
    below = np.cumsum(is_row[order] == 0)
    out = np.empty(rows + cuts, dtype=np.int64)
    out[order] = below
    return out[cuts:]


def _also(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def sorted_runs(df: DataFrame, by: Sequence[str], number: str) -> DataFrame:
    """``df`` written in sorted runs, with a number of its own for every row."""
    return store(df.withColumn(number, F.monotonically_increasing_id()).sortWithinPartitions(*[F.col(c).asc_nulls_last() for c in (*by, number)]), "psrs")


def with_rank(df: DataFrame, by: Sequence[str], name: str = "rank", ranges: int | None = None) -> DataFrame:
    """``df`` and the rank of each row, from 1, in ascending order of the long columns ``by`` (nulls last)."""
    spark = df.sparkSession
    columns = df.columns
    number = unused("_row", columns)
    by = [*by, number]
    runs = sorted_runs(df, by[:-1], number)
    ranges = max(1, min(MAX_RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    every = max(1, runs.count() // ranges**2)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = every // 2
        for batch in batches:
            at = np.arange(skip, batch.num_rows, every)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(k[at]) for k in _keys(batch, by)], names=by)
            skip += (len(at) * every) - batch.num_rows

    numbers = ", ".join(f"`{c}` long" for c in by)
    samples = runs.select(*by).mapInArrow(sample, numbers).toArrow()  # about ranges^2 rows
    found = [samples.column(c).to_numpy() for c in by]
    order = _order(found)
    cuts = order[(np.arange(1, ranges) * len(order)) // ranges] if len(order) else order
    splitters = spark.sparkContext.broadcast([f[cuts] for f in found])
    part = unused("_range", runs.columns)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _ranges(_keys(batch, by), splitters.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, part])

    dealt = runs.mapInArrow(deal, _also(runs, part, T.IntegerType()))
    sizes = {r[0]: r[1] for r in dealt.groupBy(part).agg(F.count(F.lit(1))).collect()}  # one number a range
    offsets, before = {}, 0
    for at in sorted(sizes):
        offsets[at], before = before, before + sizes[at]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = dict(offsets)
        for batch in batches:
            ats = batch.column(part).to_numpy()
            first = np.concatenate([[0], np.flatnonzero(np.diff(ats)) + 1]) if len(ats) else []
            ends = [*first[1:], len(ats)]
            ranks = np.empty(len(ats), dtype=np.int64)
            for begin, end in zip(first, ends):
                at = int(ats[begin])
                ranks[begin:end] = np.arange(done[at] + 1, done[at] + 1 + end - begin)
                done[at] += end - begin
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ranks)], names=[*columns, name])

    ordered = [F.col(part), *[F.col(c).asc_nulls_last() for c in by]]
    merged = dealt.repartitionById(ranges, F.col(part)).sortWithinPartitions(*ordered)
    return merged.mapInArrow(place, _also(df, name, T.LongType()))
