"""The registered queries of this subpackage; each calls its operator with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.llm import bpe, collocations, fingerprints, licenses, line_dedup, minhash, mixing, neighbours, periodic_runs, suffix_dedup, token_counts, topk, toxicity
from lineweave.llm._shared import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a directory for each source, language and hundred of ids."""
    hundred = F.floor(F.col("doc_id") / 100)
    path = F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), hundred.cast("string"), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(documents(spark, sf_dir), path=path)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), with_ids=False)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(documents(spark, sf_dir), every_block=True).select("doc_id", "n_lines", "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(documents(spark, sf_dir), length=200, with_kept=False)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    return toxicity.toxicity(documents(spark, sf_dir), labels, threshold=0.3).select("doc_id", "held_out", "score", "predicted", "raw")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, rest = token_counts.split_byte_vocabulary(vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts.token_counts(documents(spark, sf_dir), first, rest)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(documents(spark, sf_dir))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = periodic_runs.with_planted_runs(documents(spark, sf_dir).select("doc_id", "text"))
    runs = periodic_runs.periodic_runs(planted, min_exponent=4, min_length=6, with_text=False)
    return runs.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir), min_words=2, max_words=3, min_count=10, share=50, top=2000)


QUERIES = {"op1_licenses": op1_licenses, "op2_bpe": op2_bpe, "op3_line_dedup": op3_line_dedup, "op4_suffix_dedup": op4_suffix_dedup, "op5_mixing": op5_mixing, "op6_minhash": op6_minhash, "op7_toxicity": op7_toxicity, "op8_token_counts": op8_token_counts, "op9_fingerprints": op9_fingerprints, "op10_topk": op10_topk, "op11_neighbours": op11_neighbours, "op12_periodic_runs": op12_periodic_runs, "op13_collocations": op13_collocations}
ORACLES: dict[str, str] = {"op10_topk": topk.ORACLE, "op13_collocations": collocations.ORACLE}
