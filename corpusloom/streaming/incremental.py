"""Incremental forms: deduplicated streams, windowed counts with late data, work that was done before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_done(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no earlier result."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def first_seen(stream: DataFrame, digest: Column, time: str, late: str = "1 hour") -> DataFrame:
    """A stream without repeated digests; state older than the watermark is dropped, so memory has a bound."""
    return stream.withColumn("digest", digest).withWatermark(time, late).dropDuplicatesWithinWatermark(["digest"])


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, keys..., n) in event time, tumbling or sliding; later rows than ``late`` are left out."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")
