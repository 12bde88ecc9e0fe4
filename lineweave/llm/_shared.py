"""What the operators of this subpackage share: the shared folder, row keys, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.sources.shared import stored  # noqa: F401

#: Rows of an Arrow batch. Whole texts travel in them, so the default of 10,000 would be too many.
BATCH_ROWS = 512
#: Bytes of an Arrow batch, about: one long row more at most.
BATCH_BYTES = 64 << 20


def over_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches small enough for whole texts. The session keeps both limits, since plans run later."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def text_of(text: str = "text") -> Column:
    """The text, where null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_BUILT: dict[str, object] = {}


class PerWorker:
    """A broadcast value and what each Python worker builds from it, once."""

    def __init__(self, spark: SparkSession, value, build: Callable):
        self.key, self.value, self.build = uuid.uuid4().hex, spark.sparkContext.broadcast(value), build

    def get(self):
        if self.key not in _BUILT:
            _BUILT.clear()
            _BUILT[self.key] = self.build(self.value.value)
        return _BUILT[self.key]
