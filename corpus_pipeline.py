"""From raw documents to token ids: the five stages of the training-text pipeline.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
``run`` writes each stage as Parquet to the shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import bpe, line_dedup, minhash, mixing, toxicity
from lineweave.llm._shared import stored
from lineweave.llm.queries import vocabulary


def _key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _of_row(docs: DataFrame, made: DataFrame, columns: list[str], how: str) -> DataFrame:
    """``docs`` joined with ``made`` (doc_id, key, ``columns``: equal for equal rows) by id and text."""
    made = made.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), *columns).dropDuplicates(["__id", "__key"])
    keyed = docs.withColumn("__text", _key())
    return keyed.join(made, (F.col("__text") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), how).drop("__text", "__key", "__id")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under 0.3."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    clean = toxicity.toxicity(docs, labels, threshold=0.3).where("predicted = 0")
    return _of_row(docs, clean, [], "left_semi")


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those of which nothing is left go."""
    return line_dedup.without_common_lines(docs, every_block=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, for each component of near copies (five words, similarity 0.8)."""
    gone = minhash.near_duplicates(docs, words=5, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target words."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and decoded text."""
    return bpe.bpe_encode(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_common_lines),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode),
]

#: Trees, alignment and byte pairs have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
