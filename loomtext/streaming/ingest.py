"""Streaming ingestion: documents that arrive as files, without repeats, and a registry with a time to live."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.passes import Pipeline, run


def read_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files as they arrive under path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distinct_texts(stream: DataFrame, at: str = "ts", text: str = "text", within: str = "2 hours") -> DataFrame:
    """The first of equal texts that arrive within the watermark; state older than that is dropped."""
    marked = stream.withColumn("sha", F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).withWatermark(at, within)
    return marked.dropDuplicatesWithinWatermark(["sha"]).drop("sha")


def optimized(stream: DataFrame, mode: str = "balanced", text: str = "text") -> DataFrame:
    """A stream of documents run through the passes of a mode; every pass works on single rows."""
    return run(stream.withColumn("content", F.col(text)), Pipeline.mode(mode))


def arrivals(stream: DataFrame, at: str = "ts", key: str = "event_type", late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Counts by window and key; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
