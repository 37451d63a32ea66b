"""Target-distribution importance resampling: draw the documents whose word counts look most like a target corpus.

Features are all runs of 1 to ``longest`` consecutive words, hashed into ``buckets`` buckets
(unsigned CRC-32 of the UTF-8 bytes).  A bucket's gain is the log ratio, in thousandths and
rounded down, of its smoothed shares in the target and in the corpus; a document weighs
the sum of the gains of its features, looked up in one array of ``buckets`` numbers.  A
Gumbel draw from a hash of the id is added, so that the highest scores are a sample without
replacement in proportion to the weights.  The documents are ranked by ``psrs`` (parallel
sorting by regular sampling, exact ranks from prefix counts) and the first of them drawn.

Both passes over the texts are whole; what a task holds is bounded by ``buckets`` and by
``HELD`` distinct features.  The driver gets one number a bucket and range.

Defined results: a null or empty text has no features, weight 0 and is never drawn unless
``least_words`` is 0; an empty corpus gives an empty result, an empty target smooths to
equal shares; a null id hashes as an empty text and comes last among ties; ties go to the
smaller id, then to the row read first; repeated rows are ranked one by one; columns
beyond id and text are never read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import psrs
from .common import store
from .words import LETTERS_DIGITS, texts, words

HELD = 300_000

SCORED = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight", "score")])


def features(text: bytes, longest: int) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a text: how many words begin in it, and the features that end in it."""
    tail: list[bytes] = []
    for some in words(text, LETTERS_DIGITS):
        found, joined = list(some), tail + some
        for n in range(2, longest + 1):
            first = max(0, len(tail) - n + 1)
            found += [b" ".join(joined[i : i + n]) for i in range(first, len(joined) - n + 1)]
        tail = joined[len(joined) - longest + 1 :] if longest > 1 else []
        yield len(some), found


def bucket_counts(table: DataFrame, text_col: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(buckets, dtype=np.int64), Counter()

        def settle() -> None:
            at = np.fromiter((zlib.crc32(w) % buckets for w in held), np.int64, len(held))
            np.add.at(total, at, np.fromiter(held.values(), np.int64, len(held)))
            held.clear()

        for batch in batches:
            for text in texts(batch.column(0)):
                for _, found in features(text, longest):
                    held.update(found)
                    if len(held) > HELD:
                        settle()
        settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = table.select(text_col).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():  # one number a bucket
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """floor(1000 ln of target share / corpus share) of each bucket, each share smoothed by one feature a bucket."""
    n, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    over = ((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)) for a, b in zip(corpus.tolist(), target.tolist()))
    return [math.floor(1000 * math.log(x)) for x in over]


def draw(seed: int, doc_id: int | None) -> int:
    """A Gumbel draw in thousandths, rounded down, from a hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """The gain of each feature met, forgotten when there are too many."""

    def __init__(self, by_bucket: list[int]):
        self.by_bucket = by_bucket

    def __missing__(self, feature: bytes) -> int:
        if len(self) > HELD:
            self.clear()
        gain = self[feature] = self.by_bucket[zlib.crc32(feature) % len(self.by_bucket)]
        return gain


def scored(docs: DataFrame, by_bucket: list[int], seed: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket)  # one number a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = _Gains(shared.value)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                n_words = n_features = weight = 0
                for n, found in features(text, longest):
                    n_words, n_features = n_words + n, n_features + len(found)
                    weight += sum(map(gain.__getitem__, found))
                out.append((doc_id, n_words, n_features, weight, weight + draw(seed, doc_id)))
            columns = zip(*out) if out else [[]] * len(SCORED)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=SCORED)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, ", ".join(f"{c} long" for c in SCORED.names))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, buckets: int = 10_000, longest: int = 1,
    least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Every document's (doc_id, n_words, n_features, weight, score) and its rank among the drawn (else null).

    floor(percent * N / 100) documents are drawn of the N with ``least_words`` words or more.
    """
    by_bucket = gains(bucket_counts(docs, text_col, buckets, longest), bucket_counts(target, target_col, buckets, longest))
    rows = store(scored(docs, by_bucket, seed, longest, id_col, text_col), "resample")
    enough = F.col("n_words") >= least_words
    drawn = rows.where(enough).count() * percent // 100
    ranked = psrs.with_rank(rows.where(enough).withColumn("down", -F.col("score")), ["down", "doc_id"]).drop("down")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
