"""Lempel-Ziv phrase fingerprints.

A text's bytes are parsed into dictionary phrases (each the longest phrase met
before plus one byte).  The set of phrases is hashed, and the ``KEPT`` smallest hashes
are the fingerprint: a minimum-hash sketch.  The likeness of two fingerprints is the
sketch's estimate of the Jaccard similarity of the phrase sets, a similarity of
the kind that joint compression measures.

``with_neighbours`` compares every document with an edited copy of itself and with
its successor in ascending id order.  Documents go to ranges of ids, each range
also gets the first document of the next one, and a task walks its sorted range
holding two documents at a time; so the successor costs no second copy of the
corpus.  A document and its edited copy share the parse of what they have in common.

Defined results: a null text is an empty one; an empty text has no phrase, and two
such fingerprints have likeness 1, one and another 0; null ids come first; equal
ids are ordered by text; repeated rows come back repeated; a lone document is its
own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, store

KEPT = 64
DIGITS = 8
FACTOR, MASK = 0x5851F42D4C957F2D >> 8, (1 << 56) - 1
OUT_ROWS = 256


class Phrases:
    """Phrase dictionary of a text, as a tree of bytes; what was added last can be taken back."""

    def __init__(self):
        self.tree: dict[int, int] = {}
        self.keys: list[int] = []
        self.hashes: list[int] = [0]  # of the phrase at each node; node 0 is the empty phrase
        self.node = 0  # where the unfinished phrase stands, times 256

    def feed(self, raw: bytes) -> None:
        tree, get, keys, hashes, node = self.tree, self.tree.get, self.keys, self.hashes, self.node
        for byte in raw:
            key = node + byte
            node = get(key)
            if node is None:
                keys.append(key)
                tree[key] = len(hashes) << 8
                hashes.append((hashes[key >> 8] * FACTOR + byte + 1) & MASK)
                node = 0
        self.node = node

    def mark(self) -> tuple[int, int]:
        return len(self.keys), self.node

    def back(self, mark: tuple[int, int]) -> None:
        size, self.node = mark
        for key in self.keys[size:]:
            del self.tree[key]
        del self.keys[size:]
        del self.hashes[size + 1 :]

    def sketch(self) -> np.ndarray:
        """The smallest hashes of the phrase set, ascending."""
        h = np.array(self.hashes[1:], dtype=np.uint64)
        with np.errstate(over="ignore"):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        h = (h >> np.uint64(64 - 4 * DIGITS)).astype(np.uint32)
        if len(h) > 4 * KEPT:
            h = np.partition(h, 2 * KEPT)[: 2 * KEPT]
        return np.unique(h)[:KEPT]


def sketch_of(text: str | None) -> np.ndarray:
    phrases = Phrases()
    phrases.feed((text or "").encode("utf-8", "replace"))
    return phrases.sketch()


def as_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smallest hashes of both sets together that lie in both."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:KEPT]
    return float(np.intersect1d(np.intersect1d(a, b, True), union, True).size / union.size)


def fingerprint(text: Column | str) -> Column:
    """Fingerprint text: the sketch's hashes in hexadecimal, ascending."""

    small_batches()

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([as_text(sketch_of(t)) for t in texts], dtype=object)

    return of(text)


def similarity(a: Column | str, b: Column | str) -> Column:
    """Likeness of two fingerprint texts, 0 to 1 (null if one is null)."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        read = lambda s: np.frombuffer(bytes.fromhex(s), dtype=">u4")
        return pd.Series([None if p is None or q is None else likeness(read(p), read(q)) for p, q in zip(x, y)], dtype="float64")

    return of(a, b)


class _Held:
    """A document whose successor has not come yet: its sketch, and its parse up to where the edit begins."""

    def __init__(self, doc_id: int | None, text: str, last: bool):
        self.doc_id, self.text, self.cut = doc_id, text, len(text) - len(text) // 4
        self.phrases = Phrases()
        if not last:
            self.phrases.feed(text[: self.cut].encode("utf-8", "replace"))
            mark = self.phrases.mark()
            self.phrases.feed(text[self.cut :].encode("utf-8", "replace"))
            self.sketch = self.phrases.sketch()
            self.phrases.back(mark)
        else:  # only seen as a successor
            self.sketch = sketch_of(text)

    def finish(self, successor: _Held) -> dict:
        tail = successor.text[: len(self.text) - self.cut]
        self.phrases.feed(tail.encode("utf-8", "replace"))
        edited = self.phrases.sketch()
        whole = (self.text[: self.cut] + tail).encode("utf-8", "replace")
        return {
            "doc_id": self.doc_id, "n_chars": len(self.text), "edited_sha256": hashlib.sha256(whole).hexdigest(),
            "fingerprint": as_text(self.sketch), "edited_fingerprint": as_text(edited),
            "near_edited": likeness(self.sketch, edited), "near_next": likeness(self.sketch, successor.sketch),
        }


OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
ARROW_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
     ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, at, out = None, None, []
    for batch in batches:
        for bucket, extra, doc_id, text in zip(*(batch.column(i) for i in range(4))):
            bucket, now = bucket.as_py(), _Held(doc_id.as_py(), text.as_py() or "", extra.as_py() == 1)
            if held is not None and bucket == at:
                out.append(held.finish(now))
            held, at = now, bucket
            if len(out) >= OUT_ROWS:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW_OUT)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=ARROW_OUT)


def with_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every document and its edited copy, and likeness to the copy and to the successor.

    The edited copy has the last quarter of its code points replaced by the
    first as many of the successor's; the last document's successor is the first.
    """
    spark = docs.sparkSession
    ranges = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 20 * ranges)).first()[0]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>")
    bucket = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b < F.col("doc_id"))))
    docs = docs.withColumn("bucket", bucket.cast("int"))
    # the first document of each range, one row a range: ids alone first, then their texts
    least = docs.groupBy("bucket").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull().cast("int")).alias("nulls")
    )
    least = least.select("bucket", F.when(F.col("nulls") == 0, F.col("least")).alias("least"))
    found = store(least, "lz")
    joined = docs.join(found.withColumnRenamed("bucket", "b"), (F.col("bucket") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("least")))
    firsts = store(joined.groupBy("bucket", "doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "lz")
    order = Window.partitionBy().orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    extras = firsts.select(before.alias("bucket"), F.lit(1).alias("extra"), "doc_id", "text")
    rows = docs.select("bucket", F.lit(0).alias("extra"), "doc_id", "text").unionByName(extras)
    small_batches()
    rows = rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")
    return rows.mapInArrow(_walk, OUT)
