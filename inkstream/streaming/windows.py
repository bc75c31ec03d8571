"""Windows of event streams: the same expressions for batch and streaming frames. Event time is a timestamp in UTC."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_stream(spark, folder: str, schema, files_per_batch: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder, with event time as a timestamp (a watermark takes no other type)."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def hops(events: DataFrame, keys: list[str], at: str, value: str, length: str, slide: str | None = None) -> DataFrame:
    """keys, start, n, total of each window; for a stream, set a watermark on `at` before."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return events.groupBy(*keys, span.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, keys: list[str], at: str, gap: str) -> DataFrame:
    """keys, start, end (the last event and the gap), n of each session."""
    return events.groupBy(*keys, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_echoes(events: DataFrame, keys: list[str], at: str, tie: str, seconds: float) -> DataFrame:
    """Batch: rows whose predecessor of equal keys is more than `seconds` before. (A stream does this in keyed state.)"""
    w = Window.partitionBy(*keys).orderBy(at, tie)
    apart = (F.unix_micros(F.to_timestamp(F.col(at))) - F.lag(F.unix_micros(F.to_timestamp(F.col(at)))).over(w)) / 1e6
    return events.withColumn("_apart", apart).where(F.col("_apart").isNull() | (F.col("_apart") > seconds)).drop("_apart")


def pickup_counts(pickups: DataFrame, keys: list[str]) -> DataFrame:
    """Running counts of open and resolved pickups; for a stream, write it in update mode."""
    return pickups.groupBy(*keys).agg(F.count_if(F.col("status") == "open").alias("open"), F.count_if(F.col("status") != "open").alias("resolved"))
