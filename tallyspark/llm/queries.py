"""The registered training-data queries: each applies one operator to the whole ``documents`` table.

A query only derives digest columns from what its operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (
    bpe, divergence, langid, licenses, lzprint, mixing, oracles, passages, quality, rans, ranking, resample, secrets, simhash,
)
from .common import read_documents, read_table, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(f):
    QUERIES[f.__name__] = f
    return f


@register
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(read_documents(spark, sf_dir), shingle=3, max_bits=2)
    return found.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


@register
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir).withColumn("found", secrets.find_spans(F.col("text")))
    found = F.col("found")
    count = lambda kind: F.size(secrets.of_kinds(found, kind)).cast("long").alias(f"n_{kind}")
    base = [r.kind for r in secrets.RULES if r.base]
    base_text = secrets.spans_text(secrets.of_kinds(found, *base))
    return docs.select(
        "doc_id",
        *[count(kind) for kind in base],
        F.sha2(base_text.cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(found).alias("spans"),
    )


@register
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.find(read_documents(spark, sf_dir))
    text = F.transform("spans", lambda s: F.concat_ws(":", s["begin"], s["end"], s["other"]))
    return found.select("doc_id", "class_id", "n_links", F.array_join(text, ",").alias("passages"), "n_sharing")


@register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_documents(spark, sf_dir))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"quality.{c}") for c in counts], "base_failed", "kept", "distance")


@register
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows with one id or none are told apart by their text: its digest is what is shuffled
    docs = read_documents(spark, sf_dir).select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("text"))
    return mixing.schedule(docs).drop("text")


@register
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = read_documents(spark, sf_dir).select("doc_id", bpe.encode("text", *vocabulary).alias("ids"))
    docs = docs.select("doc_id", "ids", bpe.decode("ids", *vocabulary).alias("decoded"))
    return docs.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op10_rans_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "rans")
    vocabulary = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rans.write(read_documents(spark, sf_dir), path, *vocabulary, end_id=2, added=True)
    return rans.read(spark, path).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@register
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = langid.learn(docs.where(fold != 1), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    docs = docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "text")
    docs = docs.select("doc_id", "held_out", langid.predict("text", model, spark).alias("p"))
    return docs.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


@register
def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lzprint.with_neighbours(read_documents(spark, sf_dir))


@register
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read_documents(spark, sf_dir), windows=True)
    words, base = F.col("places.word"), F.col("places.label")
    both = F.array_union(base, F.col("wrapped.label"))
    listed = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    best = F.array_max(F.col("wrapped.containment"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(words).cast("long").alias("first_word"),
        F.array_max(words).cast("long").alias("last_word"),
        listed(base).alias("base_labels"),
        listed(both).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


@register
def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_documents(spark, sf_dir), min_docs=10, top_terms=10)


@register
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = read_table(spark, sf_dir, "benchmark", "item_id long, text string")
    found = resample.resample(read_documents(spark, sf_dir), target, percent=10, seed=2024, buckets=10_000, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@register
def op13_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every text is described once, for the fit and for its score: the labels are joined with statistics, not with texts
    docs = store(read_documents(spark, sf_dir).select("doc_id", ranking.described("text").alias("x")), "described")
    labels = read_table(spark, sf_dir, "labels", "doc_id long, quality int, toxic int")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = ranking.learn(docs, labels.where(~held_out), cutoff=0.7, x_col="x")
    scored = docs.select("doc_id", held_out.alias("held_out"), ranking.score_described("x", model, spark).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


ORACLES.update(
    op3_secret_scan=oracles.secret_scan(),
    op8_license_scan=oracles.license_scan(),
    op11_divergence_audit=oracles.divergence_audit(),
    op12_resample=oracles.importance_resample(),
)
