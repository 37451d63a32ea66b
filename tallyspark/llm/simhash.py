"""SimHash near-duplicate documents (pigeonhole blocks, verified Hamming distance).

A document's fingerprint has 64 bits: bit *b* is set when more than half of its
word shingles have bit *b* set in their XXH64 hash.  Two documents are linked when
their fingerprints differ in at most ``max_bits`` bits; a document's class is the
set of documents reachable over links.

Candidate search is exact.  The 64 bits are cut into ``max_bits + 3`` blocks; two
fingerprints within ``max_bits`` bits agree on at least three of them, so a join
on every choice of three blocks meets each close pair.  A bucket with more than
``MAX_BUCKET`` distinct fingerprints is cut the same way over its free bits, which
leaves at most 2**11 values per bucket (``max_bits`` = 2), so no bucket grows with
the corpus.  Every bucket returns a spanning forest of its verified links, never
its pairs.  Equal fingerprints are one vertex.

Defined results: a null or blank text has fingerprint 0 and is linked like any
other; a null id counts for its class but is never the class id (null if the
class has no other); repeated rows come back repeated; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, store, unused
from .graph import components

HASH_SEED = 42
MAX_BUCKET = 2048


def simhash64(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles; only A-Z is lower-cased, only ASCII space splits."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(flat, HASH_SEED)], dtype=np.uint64)
    else:
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        begins = (ends - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        spans = zip(begins, ends[shingle - 1 :].tolist())
        hashes = np.array([digest(flat[a:b], HASH_SEED) for a, b in spans], dtype=np.uint64)
    set_bits = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(set_bits * 2 > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprint(text: Column | str, shingle: int = 3) -> Column:
    """Fingerprint column (long); texts cross to Python in Arrow batches, nothing else does."""

    small_batches()

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash64(t, shingle) for t in texts], dtype="int64")

    return of(text)


def fingerprint_text(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _cut(bits: list[int], parts: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(bits, parts)]


def _as_long(bits) -> int:
    return int(np.uint64(sum(1 << int(b) for b in bits)).view(np.int64))


def block_masks(bits: list[int], max_bits: int) -> list[list[int]]:
    """Bit sets of which two values within ``max_bits`` differing bits of ``bits`` share at least one."""
    blocks = _cut(bits, max_bits + 3)
    return [[b for block in chosen for b in block] for chosen in combinations(blocks, 3)]


def _buckets(keyed: DataFrame) -> DataFrame:
    """(bucket, fp) rows of buckets that hold two or more fingerprints, with their size."""
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return keyed.join(sizes, "bucket")


def _forest(values: list[int], max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links within one bucket."""
    fps = np.sort(np.asarray(values, dtype=np.int64)).view(np.uint64)
    links, unseen = [], np.ones(len(fps), dtype=bool)
    for first in range(len(fps)):
        if not unseen[first]:
            continue
        unseen[first], queue = False, [first]
        while queue:
            at = queue.pop()
            left = np.flatnonzero(unseen)
            near = left[np.bitwise_count(fps[left] ^ fps[at]) <= max_bits]
            unseen[near] = False
            queue.extend(near.tolist())
            links.extend((int(fps[at].view(np.int64)), int(fps[n].view(np.int64))) for n in near)
    return links


def links(fps: DataFrame, max_bits: int = 2, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Verified links (a, b) that connect every class of the distinct fingerprints in ``fps.fp``."""
    tables = block_masks(list(range(64)), max_bits)
    key = F.array(
        *[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_as_long(m))).alias("k")) for i, m in enumerate(tables)]
    )
    level1 = _buckets(fps.select("fp", F.explode(key).alias("bucket")))
    finer = []
    for i, mask in enumerate(tables):
        free = sorted(set(range(64)) - set(mask))
        finer.append(
            F.array(
                *[
                    F.struct(
                        F.lit(len(tables) * (j + 1) + i).alias("t"),
                        F.col("fp").bitwiseAND(F.lit(_as_long(mask + sub))).alias("k"),
                    )
                    for j, sub in enumerate(block_masks(free, max_bits))
                ]
            )
        )
    by_table = F.element_at(F.array(*finer), F.col("bucket.t") + 1)
    level2 = level1.where(F.col("size") > max_bucket).select("fp", F.explode(by_table).alias("bucket"))
    ready = level1.where(F.col("size") <= max_bucket).unionByName(_buckets(level2))
    groups = ready.groupBy("bucket").agg(F.collect_list("fp").alias("fps"))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forest(lists: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in _forest(x, max_bits)] for x in lists])

    return groups.select(F.explode(forest("fps")).alias("l")).select("l.a", "l.b").distinct()


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2,
    max_bucket: int = MAX_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, fp (long), component_id, class_fp."""
    docs = store(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")), "simhash")
    groups = docs.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(groups.select("fp"), max_bits, max_bucket)).withColumnRenamed("node", "fp")
    groups = groups.join(roots, "fp", "left").withColumn("class_fp", F.coalesce("root", "fp"))
    ids = groups.groupBy("class_fp").agg(F.min("least").alias("component_id"))
    of_fp = groups.select("fp", "class_fp").join(ids, "class_fp")
    return docs.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "class_fp")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, ties by text.

    An id with different texts may stand for several classes, with one row for each.

    Rows without an id stay only where their whole class has none, again one a class.
    """
    nth, fp, kind, least = (unused(c, docs.columns) for c in ("nth", "fp", "class", "least"))
    found = classes(docs.select(id_col, text_col), id_col, text_col, shingle, max_bits)
    found = found.toDF(id_col, fp, least, kind)
    own = F.col(id_col) == F.col(least)
    ids = found.groupBy(id_col).agg((F.min(fp) == F.max(fp)).alias(nth), F.max(own).alias(least)).where(F.col(least))
    order = [F.col(text_col), F.xxhash64(*docs.columns)]

    def first(rows: DataFrame, of: str) -> DataFrame:
        one = F.row_number().over(Window.partitionBy(of).orderBy(*order))
        return rows.withColumn(nth, one).where(F.col(nth) == 1).select(*docs.columns)

    named = first(docs.join(ids.where(F.col(nth)), id_col, "left_semi"), id_col)
    # of an id with several fingerprints, the rows of the classes that it names: only these are hashed again
    several = ids.where(~F.col(nth)).select(id_col)
    classes_of = found.where(own).join(several, id_col, "left_semi").select(id_col, fp, kind).distinct()
    rows = docs.join(several, id_col, "left_semi").withColumn(fp, fingerprint(F.col(text_col), shingle))
    named = named.unionByName(first(rows.join(classes_of, [id_col, fp]), kind))
    lone = found.where(F.col(least).isNull()).select(fp, kind).distinct()
    unnamed = docs.where(F.col(id_col).isNull()).withColumn(fp, fingerprint(F.col(text_col), shingle)).join(lone, fp)
    return named.unionByName(first(unnamed, kind))
