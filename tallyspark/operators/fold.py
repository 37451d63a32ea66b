"""Greedy ordered fold: the batch form of "check, then apply" ledger writes.

State per key is a non-negative *level* (units in stock, or cents owed).
Each command either ``add``s to it (restock, new debt) or tries to ``take``
from it (sale, payment): a take is accepted only when it fits, and a
rejected take changes nothing (a take may need a little more than it takes,
``_extra``).  Because of that, a running ``sum() OVER`` is wrong; the commands of a key
have to be applied in order.  Commands that failed validation travel along as
``skip``: rejected, state unchanged.

The commands are range-partitioned once by key and order, so that a key of any size is
spread over as many partitions as it needs, and the sorted partitions are walked and
written to the shared folder.  Commands that lie ``clustered`` already, as a join by the key leaves them,
are sorted and walked where they lie instead, without another shuffle: only keys that turn out to have rows in
several partitions (a skewed join is split) are range-partitioned.

1. A key whose commands all lie inside one partition, ``RUN`` of them at most, is settled
   on the spot: together with its neighbours by segmented running sums where everything
   fits, and row by row in slices where something does not.
2. The commands of every other key are cut into *runs* of at most ``RUN`` rows.  Each run
   has a net change and a *need*, the smallest entry level at which all of it
   fits.  Chained per key (one row a run), they give the exact entry level of every run up to
   the first that does not fit.
3. From there on each run is summed up as a step function from its entry level to
   its exit level: below the need, the levels fall into intervals, each shifted by what the
   run takes and adds when it is entered there.  A key's functions are applied one after the other
   (a binary search a run), which gives every run its entry level.
4. The runs are replayed from their entry levels, each on its own.

So the only sequential work on a key is one small step for ``RUN`` of its rows.

Optionally the fold also tracks a *mark*: the latest non-null value of a
column seen so far on the key (e.g. the buy price set by the last restock),
reported for every row as ``mark_at``.

Calling the fold runs jobs that write the commands, the partitions and the summary of runs; the
commands are evaluated once.  What it returns is a plan over these tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from .order import stored

ADD = 0
TAKE = 1
SKIP = 2

HELPERS = ("_opening", "_opening_mark", "_mark", "_extra")
SUMS = ("_change", "_need", "_last")  # a run's net change, need and last mark
SLICE = 512  # rows of one key settled at once where they all fit or none does
FEW = 64  # rows of one key that are rather walked than sliced
RUN = 512  # rows of a key that one step of the chain stands for

def replay(kinds: np.ndarray, amounts: np.ndarray, level: int, extras: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, level after) of one key's commands in order, from ``level``."""
    accepted = np.zeros(len(kinds), dtype=bool)
    after = np.empty(len(kinds), dtype=np.int64)
    extras = np.zeros(len(kinds), dtype=np.int64) if extras is None else extras
    add, take = kinds == ADD, kinds == TAKE
    for begin in range(0, len(kinds), SLICE):
        part = slice(begin, begin + SLICE)
        a, t, x, e = add[part], take[part], amounts[part], extras[part]
        running = np.cumsum(np.where(a, x, 0) - np.where(t, x, 0))
        if not t.any() or level + (running - e)[t].min() >= 0:
            accepted[part] = a | t
            after[part] = level + running
        elif level + x[a].sum() < (x + e)[t].min():
            accepted[part] = a
            after[part] = level + np.cumsum(np.where(a, x, 0))
        else:
            rows = zip(a.tolist(), t.tolist(), x.tolist(), e.tolist())
            for i, (is_add, is_take, amount, extra) in enumerate(rows, begin):
                if is_add:
                    level += amount
                    accepted[i] = True
                elif is_take and amount + extra <= level:
                    level -= amount
                    accepted[i] = True
                after[i] = level
        level = int(after[min(begin + SLICE, len(kinds)) - 1])
    return accepted, after


class Steps:
    """What a run does to a level, as intervals: from ``starts[i]`` on, the level moves by ``shifts[i]``.

    Exact for every entry level from 0 on; the last interval has no end.
    """

    def __init__(self):
        self.starts, self.shifts = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def add(self, amount: int) -> None:
        self.shifts = self.shifts + amount

    def take(self, amount: int, extra: int) -> None:
        """Levels that hold ``amount + extra`` lose ``amount``: an interval of which only the upper part does is cut."""
        fits_from = amount + extra - self.shifts
        ends = np.append(self.starts[1:], np.iinfo(np.int64).max)
        cut = np.flatnonzero((fits_from > self.starts) & (fits_from < ends))
        taken = self.shifts - np.where(fits_from <= self.starts, amount, 0)
        self.starts = np.insert(self.starts, cut + 1, fits_from[cut])
        self.shifts = np.insert(taken, cut + 1, self.shifts[cut] - amount)
        if len(self.starts) > 64:
            self.join()

    def join(self) -> None:
        """Neighbouring intervals with one shift become one."""
        new = np.append(True, self.shifts[1:] != self.shifts[:-1])
        self.starts, self.shifts = self.starts[new], self.shifts[new]

    def __call__(self, level: int) -> int:
        return level + int(self.shifts[np.searchsorted(self.starts, level, side="right") - 1])


def run_steps(kinds: np.ndarray, amounts: np.ndarray, extras: np.ndarray) -> Steps:
    out = Steps()
    for kind, amount, extra in zip(kinds.tolist(), amounts.tolist(), extras.tolist()):
        if kind == ADD:
            out.add(amount)
        elif kind == TAKE:
            out.take(amount, extra)
    out.join()
    return out


def _numbers(rows: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    return rows.column(name).to_numpy() if isinstance(rows, pa.Table) else rows.column(name).to_numpy(zero_copy_only=False)


def _begins(rows: pa.Table, names: list[str]) -> np.ndarray:
    """Where a new value of the columns begins."""
    n, other = rows.num_rows, np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for name in names:
        column = rows.column(name)
        here, before = column.slice(1), column.slice(0, n - 1)
        other |= pc.fill_null(pc.not_equal(here, before), False).to_numpy()
        other |= pc.not_equal(pc.is_null(here), pc.is_null(before)).to_numpy()
    return np.append(0, np.flatnonzero(other) + 1)


def _nets(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kinds, amounts, extras = (_numbers(rows, c) for c in ("_kind", "_amount", "_extra"))
    net = np.where(kinds == ADD, amounts, 0) - np.where(kinds == TAKE, amounts, 0)
    return kinds, amounts, extras, net


def _running(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums inside the segments, and the segment of each row."""
    sums = np.cumsum(values)
    segment = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(values))))
    return sums - (sums[begins] - values[begins])[segment], segment


def _settle(rows: pa.Table, begins: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(accepted, level after) of segments of rows, each from its opening level."""
    kinds, amounts, extras, net = _nets(rows)
    running, segment = _running(net, begins)
    after, accepted = opening[segment] + running, kinds != SKIP
    short = np.flatnonzero(np.bincount(segment[(kinds == TAKE) & (after < extras)], minlength=len(begins)))
    if not len(short):
        return accepted, after
    ends = np.append(begins[1:], len(net))
    long = ends[short] - begins[short] > FEW
    for i in short[long].tolist():
        part = slice(begins[i], ends[i])
        accepted[part], after[part] = replay(kinds[part], amounts[part], int(opening[i]), extras[part])
    few = short[~long]
    rows_of = np.isin(segment, few)
    rows = zip(np.flatnonzero(rows_of).tolist(), *(x[rows_of].tolist() for x in (kinds, amounts, extras, segment)))
    last, level = None, 0
    for at, kind, amount, extra, i in rows:
        if i != last:
            last, level = i, int(opening[i])
        if kind == ADD:
            level += amount
        elif kind == TAKE:
            accepted[at] = amount + extra <= level
            level -= amount if accepted[at] else 0
        after[at] = level
    return accepted, after


def _marks(rows: pa.Table, begins: np.ndarray, opening: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The last mark up to each row of its segment, from the segment's opening mark."""
    marks = rows.column("_mark").combine_chunks()
    there = pc.is_valid(marks).to_numpy(zero_copy_only=False)
    last = np.maximum.accumulate(np.where(there, np.arange(len(there)), -1))
    _, segment = _running(np.zeros(len(there), dtype=np.int64), begins)
    own = last >= begins[segment]
    found = marks.take(pa.array(np.where(own, last, 0)))
    return pc.if_else(pa.array(own), found, opening.take(pa.array(segment)))


def _result(rows: pa.Table, own: list[str], accepted, after, marks, mark: bool) -> list:
    """The result columns; skipped rows have no level and no mark."""
    live = pa.array(_numbers(rows, "_kind") != SKIP)
    out = [rows.column(c) for c in own] + [pa.array(accepted), pc.if_else(live, pa.array(after), pa.scalar(None, pa.int64()))]
    return out + ([pc.if_else(live, marks, pa.scalar(None, pa.int64()))] if mark else [])


def _place(keys: list[str], own: list[str], mark: bool, run_rows: int, whole_keys: bool = False):
    """Walk a sorted partition: keys that lie inside it are settled, all others cut into runs.

    With ``whole_keys`` also its first and its last key are taken to lie inside it.
    """
    helpers = ["_opening", "_extra", *(["_mark", "_opening_mark"] if mark else [])]

    def settled(rows: pa.Table, begins: np.ndarray) -> pa.Table:
        at = pa.array(begins)
        accepted, after = _settle(rows, begins, rows.column("_opening").take(at).to_numpy())
        marks = _marks(rows, begins, rows.column("_opening_mark").take(at).combine_chunks()) if mark else None
        columns = _result(rows, own, accepted, after, marks, mark)
        return columns + [pa.nulls(rows.num_rows, pa.int64())] * (4 if mark else 3) + [rows.column(c) for c in helpers]

    def cut(rows: pa.Table, run: int) -> pa.Table:
        n = rows.num_rows
        blank = [pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), *([pa.nulls(n, pa.int64())] if mark else [])]
        kinds, _, extras, net = _nets(rows)
        running, takes = np.cumsum(net), kinds == TAKE
        need = max(0, int((extras - running)[takes].max())) if takes.any() else 0
        lead = [int(running[-1]), need]  # of the whole run, on its first row
        if mark:
            marks = rows.column("_mark").drop_null()
            lead.append(marks[-1].as_py() if len(marks) else None)
        sums = [pa.array([x] + [None] * (n - 1), pa.int64()) for x in lead]
        columns = [rows.column(c) for c in own] + blank + [pa.array(np.full(n, run, dtype=np.int64))] + sums
        return columns + [rows.column(c) for c in helpers]

    names = [*own, "accepted", "level_after", *(["mark_at"] if mark else []), "_run", *SUMS[: 3 if mark else 2], *helpers]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 33
        held: pa.Table | None = None
        spread = not whole_keys  # the first key may have rows in the partition before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
            begins = _begins(held, keys)
            if spread and len(begins) > 1:  # the end of a key that is cut into runs
                for part in range(0, int(begins[1]), run_rows):
                    yield from _batches(cut(held.slice(part, min(run_rows, int(begins[1]) - part)), run), names)
                    run += 1
                held, begins, spread = held.slice(int(begins[1])), begins[1:] - begins[1], False
            if len(begins) > 1:
                whole = held.slice(0, int(begins[-1]))
                sizes = np.diff(begins)
                for long in np.flatnonzero(sizes > run_rows).tolist():
                    for part in range(int(begins[long]), int(begins[long + 1]), run_rows):
                        yield from _batches(cut(whole.slice(part, min(run_rows, int(begins[long + 1]) - part)), run), names)
                        run += 1
                short = np.repeat(sizes <= run_rows, sizes)
                few = whole if short.all() else whole.filter(pa.array(short))
                if few.num_rows:
                    few = few.combine_chunks()
                    kept = sizes[sizes <= run_rows]
                    yield from _batches(settled(few, np.cumsum(kept) - kept), names)
                held = held.slice(int(begins[-1]))
            while held.num_rows > run_rows:
                spread = True
                yield from _batches(cut(held.slice(0, run_rows), run), names)
                held, run = held.slice(run_rows), run + 1
        if held is not None and held.num_rows:  # the last key may go on in the next partition
            rest = settled(held, np.zeros(1, dtype=np.int64)) if whole_keys and not spread else cut(held, run)
            yield from _batches(rest, names)

    return walk


def _batches(columns: list, names: list[str]) -> list[pa.RecordBatch]:
    return pa.Table.from_arrays(columns, names=names).combine_chunks().to_batches()


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by run, cut so that no run is in two pieces, and where each run begins."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        begins = _begins(held, ["_run"])
        if len(begins) > 1:
            yield held.slice(0, int(begins[-1])).combine_chunks(), begins[:-1]
            held = held.slice(int(begins[-1]))
    if held is not None:
        yield held.combine_chunks(), _begins(held, ["_run"])


def _run_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The step function of every run."""
    for rows, begins in _whole_runs(batches):
        kinds, amounts, extras, _ = _nets(rows)
        ends = np.append(begins[1:], rows.num_rows)
        steps = [run_steps(kinds[b:e], amounts[b:e], extras[b:e]) for b, e in zip(begins, ends)]
        arrays = [rows.column("_run").take(pa.array(begins)).combine_chunks()]
        arrays += [pa.array([getattr(s, c).tolist() for s in steps], pa.list_(pa.int64())) for c in ("starts", "shifts")]
        yield pa.RecordBatch.from_arrays(arrays, names=["_run", "_starts", "_shifts"])


def _chain(keys: list[str], entry: list[str]):
    """Entry levels of a key's runs, one after the other (their entry marks are known)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, level = None, 0
        for batch in batches:
            entries = []
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            starts, shifts = batch.column("_starts"), batch.column("_shifts")
            for i, (key, opening) in enumerate(zip(names, batch.column("_entry").to_pylist())):
                if key != last:
                    last, level = key, opening
                entries.append(level)
                steps = Steps()
                steps.starts, steps.shifts = (np.asarray(x[i].values.to_numpy(zero_copy_only=False)) for x in (starts, shifts))
                level = steps(level)
            known = [batch.column(c) for c in entry[1:]]
            yield pa.RecordBatch.from_arrays([batch.column("_run"), pa.array(entries, pa.int64()), *known], names=["_run", *entry])

    return walk


def _replay_runs(own: list[str], mark: bool):
    names = [*own, "accepted", "level_after", *(["mark_at"] if mark else [])]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole_runs(batches):
            at = pa.array(begins)
            accepted, after = _settle(rows, begins, rows.column("_entry").take(at).to_numpy())
            marks = _marks(rows, begins, rows.column("_entry_mark").take(at).combine_chunks()) if mark else None
            yield from _batches(_result(rows, own, accepted, after, marks, mark), names)

    return walk


def _fields(df: DataFrame, names: list[str]) -> list[StructField]:
    return [StructField(n, df.schema[n].dataType, True) for n in names]


def _entries(runs: DataFrame, keys: list[str], mark: bool) -> DataFrame:
    """The entry level of every run if all fit before it, and whether a run before it, or itself, does not fit."""
    sums = runs.where(F.col("_need").isNotNull())  # one row a run
    chain = Window.partitionBy(*keys).orderBy("_run")
    before, upto = chain.rowsBetween(Window.unboundedPreceding, -1), chain.rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_entry", F.col("_opening") + F.coalesce(F.sum("_change").over(before), F.lit(0)))
    misses = F.max((F.col("_entry") < F.col("_need")).cast("int"))
    sums = sums.withColumn("_late", misses.over(upto) == 1)
    if mark:
        sums = sums.withColumn("_entry_mark", F.coalesce(F.last("_last", ignorenulls=True).over(before), F.col("_opening_mark")))
    return sums.select(*keys, "_run", "_entry", "_late", *(["_entry_mark"] if mark else []))


def greedy_fold(
    commands: DataFrame, key_cols: list[str], order_cols: list[str], mark: bool = False, spread: str | None = None,
    run_rows: int = RUN, clustered: bool = False,
) -> DataFrame:
    """Apply ordered add/take commands per key.

    ``commands`` must carry ``_kind`` (ADD/TAKE/SKIP), ``_amount`` (long,
    ≥ 0), ``_opening`` (long level before the batch) and, when ``mark`` is
    set, ``_mark`` (long or null) and ``_opening_mark``; optionally ``_extra``
    (long, ≥ 0: what a take needs beyond its amount).  Returns the commands
    (minus those helper columns) with ``accepted``, ``level_after`` and, with
    ``mark``, ``mark_at`` (both null for skipped rows).  ``spread`` names a
    unique column that breaks ties of the order.  ``clustered`` says that the rows of a key mostly lie in
    one partition; the result is the same if they do not.
    """
    if "_extra" not in commands.columns:
        commands = commands.withColumn("_extra", F.lit(0).cast("long"))
    own = [c for c in commands.columns if c not in HELPERS]
    by = [*key_cols, *order_cols, *([spread] if spread and spread not in order_cols else [])]
    results = [StructField("accepted", BooleanType()), StructField("level_after", LongType())]
    results += [StructField("mark_at", LongType())] if mark else []
    helpers = ["_opening", "_extra", *(["_mark", "_opening_mark"] if mark else [])]
    commands = commands.withColumn("_kind", F.col("_kind").cast("int"))
    sums = [StructField(c, LongType()) for c in ("_run", *SUMS[: 3 if mark else 2])]
    fields = _fields(commands, own) + results + sums + _fields(commands, helpers)
    # written first: the range partitioning reads its input twice, and what the commands come from once
    placed = commands if clustered else stored(commands, "commands").repartitionByRange(*by)
    placed = placed.sortWithinPartitions(*by).mapInArrow(_place(key_cols, own, mark, run_rows, clustered), StructType(fields))
    placed = stored(placed.withColumn("_nth", F.monotonically_increasing_id()), "fold")
    names = [*own, *[f.name for f in results]]
    again = None
    if clustered:
        part = F.shiftright("_nth", 33)
        several = placed.groupBy(*key_cols).agg(F.min(part).alias("_from"), F.max(part).alias("_to")).where("_from < _to")
        several = stored(several.select(*[F.col(k).alias(f"_in_{k}") for k in key_cols]), "spread")
        if not several.isEmpty():
            same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_in_{k}")) for k in key_cols])
            rest = placed.join(several, same, "left_semi").select(*own, *helpers)
            again = greedy_fold(rest, key_cols, order_cols, mark, spread, run_rows)
            placed = placed.join(several, same, "left_anti")

    runs = placed.where(F.col("_run").isNotNull())
    entries = stored(_entries(runs, key_cols, mark), "entries")  # one row a run
    entry = ["_entry", *(["_entry_mark"] if mark else [])]
    found = entries.where("not _late").select("_run", *entry)
    if not entries.where("_late").isEmpty():
        late = entries.where("_late")
        steps = runs.join(late.select("_run"), "_run", "left_semi").select("_run", "_nth", "_kind", "_amount", "_extra")
        steps = steps.repartition(F.xxhash64("_run")).sortWithinPartitions("_run", "_nth")
        steps = steps.mapInArrow(_run_steps, "_run long, _starts array<long>, _shifts array<long>")
        steps = late.join(steps, "_run").select(*key_cols, "_run", *entry, "_starts", "_shifts")
        # The partition hash is a derived expression, never the bare keys: a repartition on the keys can be dropped
        # as redundant after a join on them, and an adaptive local shuffle read could then split a key over tasks.
        chained = steps.repartition(F.xxhash64(*key_cols)).sortWithinPartitions(*key_cols, "_run")
        found = found.unionByName(chained.mapInArrow(_chain(key_cols, entry), ", ".join(f"{c} long" for c in ("_run", *entry))))
    rest = runs.select(*own, "_run", "_nth", "_extra", *(["_mark"] if mark else [])).join(found, "_run")
    rest = rest.repartition(F.xxhash64("_run")).sortWithinPartitions("_run", "_nth")
    schema = StructType(_fields(commands, own) + results)
    replayed = rest.mapInArrow(_replay_runs(own, mark), schema)
    result = placed.where(F.col("_run").isNull()).select(*names).unionByName(replayed)
    return result if again is None else result.unionByName(again)
