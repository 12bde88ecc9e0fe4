"""JSON and JSONL stores: whole-file arrays, append-only logs, and recognised lines in two layouts."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array, with or without a byte order mark; no rows where the path is absent."""
    try:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object for each line; malformed lines go."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def recognised_lines(results: DataFrame) -> DataFrame:
    """Lines from results with parallel arrays rec_texts, rec_scores, rec_polys: doc_id, line_idx, text, conf, pts."""
    zipped = F.arrays_zip("rec_texts", "rec_scores", "rec_polys")
    return results.select("doc_id", F.posexplode(zipped).alias("line_idx", "l")).select("doc_id", "line_idx", F.col("l.rec_texts").alias("text"), F.col("l.rec_scores").alias("conf"), F.col("l.rec_polys").alias("pts"))


def text_lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """Lines of cached text with positions made from their index: y = 10 + 20 i, h = 14, w = 8 for each character within 20 and 800.

    Blank lines go before the numbering.
    """
    # F.trim itself takes a second argument, so transform would hand it the index as the marks to cut
    trimmed = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    lines = texts.select("doc_id", F.posexplode(trimmed).alias("line_idx", "text"))
    width = F.greatest(F.lit(20), F.least(F.lit(800), 8 * F.length("text")))
    return lines.withColumn("y", 10 + 20 * F.col("line_idx")).withColumn("h", F.lit(14)).withColumn("w", width).withColumn("synthetic", F.lit(True))
