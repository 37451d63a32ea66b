"""Source divergence audit: how far the word use of a language's sources lies apart, by single-pass in-memory indexing.

Each task reads its documents once.  It builds a block of postings in memory (term ->
occurrences and documents in each group of language and source); a block that has
``block_entries`` postings or has read ``block_bytes`` of text goes out as a run sorted by
term.  Runs are dealt to hash shards of (language, term), where Spark's external sort
merges them (its spills are sorted runs, merged over a heap) and one stream adds the
postings up.  A language keeps the terms that stand in ``min_docs`` of its documents.

A term's smoothed share in a group is p = 1 + floor(SCALE * (count + 2) / (N + 2V)), with N
the group's occurrences of the V kept terms.  Two shares differ by
f = floor((p - q)^2 / (p + q)).  The sum of f over all kept terms of a pair of sources is

* V times f of both sources' shares of an absent term,
* plus, for each of the two, what its own terms change against an absent one: a histogram
  of its counts says how often,
* plus a correction for each term that both have.

Only the corrections need the postings: a second stream over the shards sums them up by
pair in memory and emits partial sums, never a row for every term and pair.  All
arithmetic is on long integers, exact while N + 2V is under 9e15.

Defined results: null text, language or source counts as ''; a source without a kept term
has shares of absent terms only; a language without kept terms has pairs of value 0 and no
terms; repeated rows count each time; ties rank by the item's UTF-8 bytes; an empty table
gives an empty result; columns beyond the named three are never read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .words import LETTERS, texts, words

SCALE = 10**9
BLOCK_ENTRIES = 400_000
BLOCK_BYTES = 1 << 28
PAIRS_HELD = 500_000
OUT_ROWS = 50_000

RUN = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("docs", pa.int64())]
)
FREQUENCY = pa.schema(
    [("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("total", pa.int64()),
     ("first", pa.int32())]
)
CORRECTION = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


class Block:
    """Postings in memory: occurrences and documents of each term, by group."""

    def __init__(self):
        self.counts, self.docs = defaultdict(Counter), defaultdict(Counter)
        self.entries = self.bytes = 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        counts, seen = self.counts[group], set()
        before = len(counts)
        for some in words(text, LETTERS):
            counts.update(some)
            seen.update(some)
        self.docs[group].update(seen)
        self.entries += len(counts) - before
        self.bytes += len(text)

    def run(self) -> Iterator[pa.RecordBatch]:
        """The postings sorted by language, term and source."""
        parts = []
        for (lang, source), counts in self.counts.items():
            docs, n = self.docs[lang, source], len(counts)
            terms = pa.array(counts.keys(), pa.binary()).cast(pa.string())
            found = [terms, pa.array(counts.values(), pa.int64()), pa.array(map(docs.__getitem__, counts), pa.int64(), size=n)]
            names = [pa.repeat(pa.scalar(x, pa.string()), n) for x in (lang, source)]
            parts.append(pa.Table.from_arrays([names[0], found[0], names[1], *found[1:]], schema=RUN))
        if parts:
            run = pa.concat_tables(parts).sort_by([(c, "ascending") for c in ("lang", "term", "source")])
            yield from run.combine_chunks().to_batches(OUT_ROWS)


def runs(docs: DataFrame, block_entries: int = BLOCK_ENTRIES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Term-sorted runs of (lang, term, source, count, docs) from ``docs`` (lang, source, text)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block()
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                block.add((lang, source), text)
                if block.entries >= block_entries or block.bytes >= block_bytes:
                    yield from block.run()
                    block = Block()
        yield from block.run()

    return docs.select("lang", "source", "text").mapInArrow(index, "lang string, term string, source string, count long, docs long")


def _whole_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by (lang, term), cut so that no term is in two pieces, and where each term begins."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        held = (rows if held is None else pa.concat_tables([held, rows])).combine_chunks()
        begins = _begins(held)
        if len(begins) > 1:
            yield held.slice(0, int(begins[-1])), begins[:-1]
            held = held.slice(int(begins[-1]))
    if held is not None:
        yield held, _begins(held)


def _begins(rows: pa.Table) -> np.ndarray:
    n, other = rows.num_rows, np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for name in ("lang", "term"):
        column = rows.column(name)
        other |= pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy()
    return np.concatenate([[0], np.flatnonzero(other) + 1])


def frequencies(found: DataFrame, min_docs: int) -> DataFrame:
    """Kept terms' (lang, term, source, count), ``total`` in the language; ``first`` is 1 once a term."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole_terms(batches):
            n = np.diff(np.append(begins, rows.num_rows))
            term = np.repeat(np.arange(len(begins)), n)
            count, docs = (rows.column(c).to_numpy() for c in ("count", "docs"))
            total = np.add.reduceat(count, begins)
            kept = np.add.reduceat(docs, begins) >= min_docs
            source = rows.column("source")
            new = np.ones(rows.num_rows, dtype=bool)  # the first row of a (term, source)
            new[1:] = pc.not_equal(source.slice(1), source.slice(0, rows.num_rows - 1)).to_numpy()
            new[begins] = True
            at = np.flatnonzero(new)
            sums = np.add.reduceat(count, at)
            keep = kept[term[at]]
            at, sums = at[keep], sums[keep]
            if len(at):
                first = np.isin(at, begins).astype(np.int32)
                names = [rows.column(c).take(pa.array(at)) for c in ("lang", "term", "source")]
                out = pa.Table.from_arrays([*names, pa.array(sums), pa.array(total[term[at]]), pa.array(first)], schema=FREQUENCY)
                yield from out.combine_chunks().to_batches()

    shards = found.repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return shards.mapInArrow(merge, "lang string, term string, source string, count long, total long, first int")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2v)) on longs: the quotient's nine digits after the point, three at a time."""
    over, by = count + 2, n + 2 * v
    out, rest = _div(over, by), over % by
    for _ in range(3):
        out, rest = out * 1000 + _div(rest * 1000, by), (rest * 1000) % by
    return out + 1


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), p + q)


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def corrections(shares: DataFrame, held: int = PAIRS_HELD) -> DataFrame:
    """Partial sums by pair (source < item) of what terms that both have change; rows are (lang, term, source, p, absent)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        sums: dict[tuple[int, int], int] = defaultdict(int)

        def partial() -> pa.RecordBatch:
            names = list(numbers)
            found = [(*names[a], names[b][1], v) for (a, b), v in sums.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), CORRECTION.types)], schema=CORRECTION)

        for rows, begins in _whole_terms(batches):
            n = rows.num_rows
            term = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))
            p, absent = (rows.column(c).to_numpy() for c in ("p", "absent"))
            coded = [pc.dictionary_encode(rows.column(c).combine_chunks()) for c in ("lang", "source")]
            langs, sources = (c.dictionary.to_pylist() for c in coded)
            both = coded[0].indices.to_numpy().astype(np.int64) * len(sources) + coded[1].indices.to_numpy()
            distinct, local = np.unique(both, return_inverse=True)
            groups = [(langs[x // len(sources)], sources[x % len(sources)]) for x in distinct.tolist()]
            for g in groups:
                numbers.setdefault(g, len(numbers))
            for apart in range(1, n):
                at = np.flatnonzero(term[apart:] == term[:-apart])
                if not len(at):
                    break
                to = at + apart
                change = _gap(p[at], p[to]) - _gap(p[at], absent[to]) - _gap(absent[at], p[to]) + _gap(absent[at], absent[to])
                pairs, where = np.unique(local[at] * len(groups) + local[to], return_inverse=True)
                value = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(value, where, change)
                for pair, v in zip(pairs.tolist(), value.tolist()):
                    sums[numbers[groups[pair // len(groups)]], numbers[groups[pair % len(groups)]]] += v
            if len(sums) >= held:
                yield partial()
                sums.clear()
        if sums:
            yield partial()

    shards = shares.select("lang", "term", "source", "p", "absent").repartition("lang", "term")
    shards = shards.sortWithinPartitions("lang", "term", "source")
    return shards.mapInArrow(walk, "lang string, source string, item string, value long")


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 10,
    top_terms: int = 10, block_entries: int = BLOCK_ENTRIES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(lang, source, part, item, value, rank): the divergence of every pair of a language's sources, and the terms
    that a source uses most above its language."""
    empty = F.lit("")
    named = [F.coalesce(F.col(c), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    docs = docs.select(*named)
    kept = store(frequencies(runs(docs, block_entries, block_bytes), min_docs), "spimi")
    none = F.lit(0).cast("long")
    langs = kept.groupBy("lang").agg(F.sum("count").alias("lang_n"), F.sum("first").cast("long").alias("v"))
    groups = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = docs.select("lang", "source").distinct().join(groups, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("n", "v", "lang_n")])
    absent = F.when(F.col("v") > 0, share(none, F.col("n"), F.col("v")))
    groups = store(groups.withColumn("absent", absent), "spimi")  # one row a group

    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
    above = shares.withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))).where("p > q")
    above = above.select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("absent").alias("other"))
    pairs = groups.select("lang", "source", "v", "n", "absent").join(other, "lang").where("source <> item")
    both_absent = gap(F.col("absent"), F.col("other"))
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("v") * both_absent, none).alias("value"))
    often = kept.groupBy("lang", "source", "count").agg(F.count(F.lit(1)).alias("times"))
    own = often.join(pairs, ["lang", "source"])
    change = F.col("times") * (gap(share(F.col("count"), F.col("n"), F.col("v")), F.col("other")) - both_absent)
    own = own.groupBy("lang", "source", "item").agg(F.sum(change).alias("value"))
    one_way = own.unionByName(corrections(shares))
    parts = base.unionByName(one_way).unionByName(
        one_way.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    )
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = sums.withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return (
        sums.withColumn("part", F.lit("pair")).select(*columns).unionByName(terms.withColumn("part", F.lit("term")).select(*columns))
    )
