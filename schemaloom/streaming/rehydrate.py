"""The same column expressions on a stream. They keep no state, so a stream needs no watermark for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rehydrate import rehydrate


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """document: a JSON value a line, of files as they come."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("value").alias("document"))


def rehydrate_stream(stream: DataFrame, codec, original, column: str = "document", mode: str = "PERMISSIVE") -> DataFrame:
    return rehydrate(stream, codec, original, column, mode=mode)


def warning_counts(stream: DataFrame, time: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: warnings by window of time and constraint, with a watermark for late rows."""
    each = stream.withWatermark(time, late).select(F.col(time), F.explode("warnings").alias("w"))
    return each.groupBy(F.window(time, width), F.col("w.kind.constraint").alias("constraint")).count()
