"""Streams of sources. Scans look at one source at a time, so that they run
on a stream of files as they do on a table of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scans


def source_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as sources (source_id, content)."""
    from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("path", StringType()), StructField("modificationTime", TimestampType()), StructField("length", LongType()), StructField("content", BinaryType())])
    files = spark.readStream.format("binaryFile").schema(schema).load(path)
    return files.select(F.col("path").alias("source_id"), "content")


def strings_stream(spark: SparkSession, path: str, minimum: int = 4) -> DataFrame:
    return scans.strings_scan(source_stream(spark, path), minimum)


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by kind and tumbling window, late ones accepted up to ``late``."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("events")).select(
        F.col("w.start").alias("start"), kind, "events"
    )
