"""Incremental questions: files asked as they arrive. An extension; the plans are the batch ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """(path, content) of new files of a folder, a bounded number at a time."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(path).select("path", "content")


def keep_asking(plan: Callable[[DataFrame], DataFrame], files: DataFrame, to: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends the rows of a plan (files.inspect, files.form_fields, ...) to a Parquet table, each file once."""
    writer = plan(files).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
