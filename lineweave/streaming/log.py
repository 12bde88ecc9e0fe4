"""The review log as a stream: counts by event type in windows of event time, late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Works on streams and tables alike: window start, kind, n, total of ``value``. State is bounded by the watermark on streams."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, size).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "kind", "n", "total")


def corrections(events: DataFrame, *, within: str = "1 hour") -> DataFrame:
    """Automatic extractions and the human corrections of the same image that follow within a time: a stream-stream join or a plain one."""
    auto = events.where("event_type = 'auto_extract'").select(F.col("image_id").alias("image"), F.col("ts").alias("at"), F.col("doc_type"))
    human = events.where("event_type = 'human_correction'").select("image_id", F.col("ts").alias("corrected_at"))
    if events.isStreaming:
        auto, human = auto.withWatermark("at", within), human.withWatermark("corrected_at", within)
    return auto.join(human, F.expr(f"image = image_id and corrected_at between at and at + interval {within}")).drop("image_id")
