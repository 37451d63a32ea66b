"""The corpus pipeline: documents through five stages, each written as Parquet and reread by the next.

1. quality rules: documents that the base rules or the outlier method reject go;
2. SimHash near-duplicates: one document of each class stays (the smallest doc_id);
3. secret scans: spans found in a text are replaced by a mark, n_chars follows;
4. mixing: all documents, laid out in the order of the Pfair mix of their sources;
5. byte-level BPE: token ids of every text, decoded again and compared, with the
   row's position in the mix (``mix_position``, from 0).

The mix is an order, not a column, so the last stage takes it from the files that it
reads: the number of the part file, then the row in it.

Null text: fails the quality rules.  An empty table passes every stage empty.
Columns beyond those of ``documents`` are carried through the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm import bpe, mixing, quality, secrets, simhash
from tallyspark.llm.common import read_documents, store

SHINGLE_WORDS, MAX_BITS = 3, 2
REMEMBERED_WORDS, ROWS_AT_ONCE, CHARS_AT_ONCE = 150_000, 200, 600_000
VOCABULARY = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(docs)
    return judged.where(F.col(judged.columns[-1])).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=SHINGLE_WORDS, max_bits=MAX_BITS)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = secrets.redact(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def with_position(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` and the place of each row in the order it was written in: part files by number, rows inside.

    A table that is not read from files is written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = store(docs, "pipeline")
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int")
    sizes = docs.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))  # one row a file
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    rows = docs.select("*", part.alias("_part"), F.col("_metadata.row_index").alias("_row"))
    placed = rows.join(F.broadcast(first), "_part").withColumn(name, F.col("_first") + F.col("_row"))
    return placed.select(*docs.columns, name)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # executors still hold what earlier stages left, so workers remember less here than the operator's default, and
    # batches are small: the words of a batch are held besides the remembered ones
    ids = bpe.encode("text", *VOCABULARY, words=REMEMBERED_WORDS, rows=ROWS_AT_ONCE, chars=CHARS_AT_ONCE)
    docs = with_position(docs.select("doc_id", "lang", "source", "text"), "mix_position")
    docs = docs.select("*", ids.alias("token_ids"))
    decoded = bpe.decode("token_ids", *VOCABULARY)
    same = decoded == F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        "doc_id", "lang", "source", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), same.alias("round_trip"),
        "mix_position",
    )


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: The robust estimates, the classes and the tokens have no SQL form: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
