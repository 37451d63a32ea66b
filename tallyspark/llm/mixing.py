"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of ``block`` rows.  Block k of a source with target
weight w (all sum to 1) is released at slot floor(k / w) and due before slot
ceil((k + 1) / w); each slot goes to the released block with the earliest deadline.
Every prefix of the order then holds of each source its target share to less than
one block, up to the first source's end.  The schedule has a step per block, in passes
of ``PASS`` slots; a block's slot is then looked up by source and number.

With ``frame``, weights are whole units of a frame of so many slots instead, at
least one unit a source, and one frame is scheduled and repeated: no pass over the
corpus, but shares are met only as closely as the units meet them.

Every row is kept and gets one slot.  ``in_mix`` marks the slots before the first
source runs out; the rows after them follow in the order of their deadlines.  A weight
of zero counts as ``LEAST_SHARE`` of all.

Ranks within a source come from salted parts: counts per (source, part) give each
part its offset, and rows are numbered inside parts, so a hot source is spread
over ``parts`` tasks.  Only DataFrame functions are used.

Defined results: null is a source of its own; rows with equal or null ids are
all kept, ordered by their text; sources without a given weight share by the
square root of their row counts (``weights=None``: all do); an empty table gives
an empty result; other columns come back unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, store, unused

FRAME = 1000
PASS = 1 << 19  # slots of a pass
STEPS = 256  # slots whose blocks are put together at once
LEAST_SHARE = 1e-9
BLOCK_ROWS = 16
PARTS = 1024


def frame_units(counts: DataFrame, frame: int = FRAME) -> DataFrame:
    """Units per source (source, share) so that they sum to ``frame``: one each, the rest by largest remainder.

    One row a source, at most ``frame`` rows: a source needs at least one slot a frame.
    """
    total = Window.partitionBy()
    n = F.count(F.lit(1)).over(total)
    rest = F.when(n > frame, F.raise_error(F.lit("more sources than slots in a frame")).cast("long")).otherwise(frame - n)
    exact = F.round(F.col("share") / F.sum("share").over(total) * rest, 9)
    out = counts.withColumn("exact", exact).withColumn("floor", F.floor("exact").cast("long"))
    left = rest - F.sum("floor").over(total)
    nth = F.row_number().over(Window.partitionBy().orderBy((F.col("floor") - F.col("exact")).asc(), F.col("source")))
    out = out.withColumn("left", left).withColumn("nth", nth)
    return out.select("source", "rows", (F.col("floor") + 1 + (F.col("nth") <= F.col("left")).cast("long")).alias("units"))


def frame_schedule(units: DataFrame, frame: int = FRAME) -> DataFrame:
    """(source, k, slot): the slot of the k-th block of each source within a frame, by earliest deadline first."""
    listed = units.agg(F.sort_array(F.collect_list(F.struct("source", "units"))).alias("s"))

    def candidates(state: Column, t: Column) -> Column:
        def one(s: Column, i: Column) -> Column:
            k, w = F.get(state["done"], i), s["units"]
            released = F.floor(k * frame / w) <= t
            due = F.ceil((k + 1) * frame / w)
            return F.when((k < w) & released, F.struct(due.alias("due"), i.alias("i"), k.alias("k")))

        return F.array_min(F.filter(F.transform(F.col("s"), one), lambda x: x.isNotNull()))

    def step(state: Column, t: Column) -> Column:
        pair = F.array(F.struct(candidates(state, t).alias("c")))
        chosen = F.transform(
            pair,
            lambda p: F.struct(
                F.transform(state["done"], lambda d, i: F.when(i == p["c"]["i"], d + 1).otherwise(d)).alias("done"),
                F.concat(
                    state["out"],
                    F.array(F.struct(p["c"]["i"].alias("i"), p["c"]["k"].alias("k"), t.cast("long").alias("slot"))),
                ).alias("out"),
            ),
        )
        return chosen[0]

    start = F.struct(
        F.transform(F.col("s"), lambda _: F.lit(0).cast("long")).alias("done"),
        F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>").alias("out"),
    )
    run = F.aggregate(F.sequence(F.lit(0), F.lit(frame - 1)), start, step, lambda state: state["out"])
    rows = listed.where(F.size("s") > 0).select("s", F.explode(run).alias("o"))
    return rows.select(F.get(F.col("s"), F.col("o.i"))["source"].alias("source"), "o.k", "o.slot")


def release(k: Column, share: Column) -> Column:
    return F.floor(F.round(k / share, 6)).cast("long")


def deadline(k: Column, share: Column) -> Column:
    return F.ceil(F.round((k + 1) / share, 6)).cast("long")


def target_shares(counts: DataFrame, block: int) -> DataFrame:
    """(source, rows, share, blocks, at, n): shares that sum to 1, the source's number and the number of sources."""
    total = Window.partitionBy()
    least = F.greatest(F.col("share"), F.sum("share").over(total) * LEAST_SHARE)
    out = counts.withColumn("least", least).withColumn("share", F.col("least") / F.sum("least").over(total))
    at = F.row_number().over(Window.partitionBy().orderBy("source")) - 1
    blocks = F.ceil(F.col("rows") / block).cast("long")
    return out.select("source", "rows", "share", blocks.alias("blocks"), at.cast("long").alias("at"), F.count(F.lit(1)).over(total).alias("n"))


def target_schedule(targets: DataFrame, slots: int = PASS, steps: int = STEPS) -> DataFrame:
    """(source, k, slot) of the blocks before the first source runs out, by earliest deadline first.

    ``targets`` as of ``target_shares``.  One row a block; the passes hand on how many blocks each source has had.
    """
    one = F.sort_array(F.collect_list(F.struct("at", "source", "share", "blocks")))
    last = F.min(deadline(F.col("blocks"), F.col("share")))  # the first missing block is due before it
    state = targets.agg(one.alias("s"), last.alias("last")).where(F.size("s") > 0)
    state = store(state.withColumns({"done": F.transform("s", lambda _: F.lit(0).cast("long")), "t": F.lit(0).cast("long"), "end": F.lit(False)}), "mix")
    none = F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>")

    def chosen(acc: Column) -> Column:
        def due(x: Column, i: Column) -> Column:
            k = F.get(acc["done"], i)
            late = release(k, x["share"]) > acc["t"]
            return F.struct(late.alias("late"), deadline(k, x["share"]).alias("due"), i.alias("i"), k.alias("k"), (k >= x["blocks"]).alias("end"))

        return F.array_min(F.transform(F.col("s"), due))

    def step(acc: Column, _: Column) -> Column:
        def taken(c: Column) -> Column:
            item = F.struct(c["i"].alias("i"), c["k"].alias("k"), acc["t"].alias("slot"))
            after = F.struct(
                F.transform(acc["done"], lambda d, i: F.when(i == c["i"], d + 1).otherwise(d)).alias("done"),
                (acc["t"] + 1).alias("t"), F.lit(False).alias("end"), F.concat(acc["out"], F.array(item)).alias("out"),
            )
            ended = F.struct(acc["done"].alias("done"), acc["t"].alias("t"), F.lit(True).alias("end"), acc["out"].alias("out"))
            return F.when(c["end"], ended).otherwise(after)

        return F.when(acc["end"], acc).otherwise(let(chosen(acc), taken))

    def several(acc: Column, _: Column) -> Column:
        start = F.struct(acc["done"].alias("done"), acc["t"].alias("t"), acc["end"].alias("end"), none.alias("out"))
        run = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
        return let(run, lambda x: F.struct(x["done"].alias("done"), x["t"].alias("t"), x["end"].alias("end"), F.concat(acc["outs"], F.array(x["out"])).alias("outs")))

    found = []
    while True:
        start = F.struct("done", "t", "end", F.array().cast("array<array<struct<i:int,k:bigint,slot:bigint>>>").alias("outs"))
        rounds = F.ceil((F.least(F.col("last") - F.col("t"), F.lit(slots)) + 1) / steps).cast("int")
        run = F.aggregate(F.sequence(F.lit(1), rounds), start, several)
        passed = store(state.select("s", "last", run.alias("r")), "mix")
        rows = passed.select("s", F.explode(F.flatten("r.outs")).alias("o"))
        found.append(rows.select(F.get(F.col("s"), F.col("o.i"))["source"].alias("source"), "o.k", "o.slot"))
        state = passed.select("s", "last", "r.done", "r.t", "r.end")
        if state.where("not end").isEmpty():
            return store(reduce(DataFrame.unionAll, found), "mix")


def _frames(counts: DataFrame, block: int, frame: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, schedule of a frame, and per source (s, units, horizon)."""
    units = store(frame_units(counts, frame), "mix")
    table = store(frame_schedule(units, frame), "mix")
    # a source runs out at the slot of its first missing block
    missing = F.ceil(F.col("rows") / block).cast("long")
    ends = units.withColumn("k", missing % F.col("units")).withColumn("full", (missing - F.col("k")) / F.col("units"))
    ends = ends.join(table, ends["source"].eqNullSafe(table["source"]) & (ends["k"] == table["k"]))
    horizon = F.min(F.col("full") * frame + F.col("slot")).over(Window.partitionBy())
    return units, table, ends.select(units["source"].alias("s"), "units", horizon.cast("long").alias("horizon"))


def schedule(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    block: int = BLOCK_ROWS,
    frame: int | None = None,
    parts: int = PARTS,
) -> DataFrame:
    """``docs`` and the columns rank, block, slot, release, deadline, in_mix (names get ``_`` where taken).

    rank is the row's number within its source in the order (hash of the id, id,
    text); slot is the place of its block in the mix.  ``parts`` is a power of two.
    """
    names = ("rank", "block", "slot", "release", "deadline", "in_mix")
    out = {k: unused(k, docs.columns) for k in names}
    own = {k: unused(f"mix_{k}", docs.columns) for k in ("source", "part", "first", "units", "horizon", "k", "at")}
    # a part is a range of the id's hash: ordering parts, then hashes inside, orders by hash
    hashed = F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)))
    part = F.shiftrightunsigned(hashed, 64 - (parts - 1).bit_length()).cast("int") if parts > 1 else F.lit(0)
    sizes = docs.groupBy(F.col(source_col).alias("source"), part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(sizes.withColumn("first", F.coalesce(F.sum("rows").over(before), F.lit(0))), "mix")

    counts = offsets.groupBy("source").agg(F.sum("rows").alias("rows"))
    share = F.sqrt("rows")
    given = [F.lit(x) for name, weight in (weights or {}).items() if name is not None for x in (name, float(weight))]
    if given:
        share = F.coalesce(F.try_element_at(F.create_map(*given), F.col("source")), share)
    if frame is None:
        own["share"], own["n"] = (unused(f"mix_{k}", docs.columns) for k in ("share", "n"))
        targets = store(target_shares(counts.withColumn("share", share), block), "mix")
        table = target_schedule(targets)
        done = targets.join(F.broadcast(table.groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("k"))), F.col("source").eqNullSafe(F.col("s")), "left")
        horizon = F.coalesce(F.sum("k").over(Window.partitionBy()), F.lit(0))
        ends = done.select(F.col("source").alias("s"), "share", "at", "n", horizon.alias("horizon"))
        extra = ("share", "at", "n", "horizon")
    else:
        _, table, ends = _frames(counts.withColumn("share", share), block, frame)
        extra = ("units", "horizon")
    of_part = offsets.join(ends, offsets["source"].eqNullSafe(ends["s"])).select(
        *[F.col(c).alias(own[c]) for c in ("source", "part", "first", *extra)]
    )

    p = unused("mix_p", [*docs.columns, *own.values()])
    rows = docs.withColumn(p, part)
    inner = Window.partitionBy(source_col, p).orderBy(hashed, F.col(id_col), F.col(text_col))
    rows = rows.withColumn(out["rank"], F.row_number().over(inner).cast("long") - 1)
    rows = rows.join(of_part, F.col(source_col).eqNullSafe(F.col(own["source"])) & (F.col(p) == F.col(own["part"])))
    rows = rows.withColumn(out["rank"], F.col(out["rank"]) + F.col(own["first"]))
    rows = rows.withColumn(out["block"], F.floor(F.col(out["rank"]) / block))
    rows = rows.drop(own["source"])
    if frame is None:
        k, w, end = F.col(out["block"]), F.col(own["share"]), F.col(own["horizon"])
        at = table.select(F.col("source").alias(own["source"]), F.col("k").alias(own["k"]), F.col("slot").alias(out["slot"]))
        rows = rows.join(at, F.col(source_col).eqNullSafe(F.col(own["source"])) & (k == F.col(own["k"])), "left")
        after = end + (deadline(k, w) - 1 - end) * F.col(own["n"]) + F.col(own["at"])  # one place a source and deadline
        slot = F.coalesce(F.col(out["slot"]), after)
        return rows.select(
            *docs.columns, F.col(out["rank"]), k, slot.alias(out["slot"]), release(k, w).alias(out["release"]),
            deadline(k, w).alias(out["deadline"]), (slot < end).alias(out["in_mix"]),
        )
    rows = rows.withColumn(own["k"], F.col(out["block"]) % F.col(own["units"]))
    at = table.select(F.col("source").alias(own["source"]), F.col("k").alias(own["at"]), F.col("slot").alias(out["slot"]))
    rows = rows.join(at, F.col(source_col).eqNullSafe(F.col(own["source"])) & (F.col(own["k"]) == F.col(own["at"])))
    whole = (F.col(out["block"]) - F.col(own["k"])) / F.col(own["units"]) * frame  # slots of the frames before
    whole = whole.cast("long")
    k, w = F.col(own["k"]), F.col(own["units"])
    return rows.select(
        *docs.columns,
        F.col(out["rank"]),
        F.col(out["block"]),
        (whole + F.col(out["slot"])).alias(out["slot"]),
        (whole + F.floor(k * frame / w)).alias(out["release"]),
        (whole + F.ceil((k + 1) * frame / w)).alias(out["deadline"]),
        (whole + F.col(out["slot"]) < F.col(own["horizon"])).alias(out["in_mix"]),
    )


def in_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` laid out in the order of the mix: ranges of slots, sorted inside; every row stays."""
    planned = schedule(docs, **options)
    slot, rank = planned.columns[len(docs.columns) + 2], planned.columns[len(docs.columns)]
    return planned.repartitionByRange(slot).sortWithinPartitions(slot, rank).select(*docs.columns)
