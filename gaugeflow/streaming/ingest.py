"""Structured Streaming over arriving captures and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arrivals(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def unique_arrivals(stream: DataFrame, content: str, at: str | None = None, delay: str | None = None) -> DataFrame:
    """Each content once. With a delay the state is bounded, and a repeat after it passes; without
    one, late arrivals of any age are recognised and the state grows with the contents."""
    if at and delay:
        return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([content])
    return stream.dropDuplicates([content])


def request_rate(requests: DataFrame, at: str, key: str, width: str, most: int) -> DataFrame:
    """Requests per key and window (batch or stream); all count, valid or not."""
    counts = requests.groupBy(F.window(at, width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") > most).alias("limited"))
