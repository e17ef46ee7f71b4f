"""Streams of arriving content: first copies within a watermark, and running counts by content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.content import full_digest, size_of


def with_digest(stream: DataFrame, content: str = "content") -> DataFrame:
    return stream.withColumn("size", size_of(F.col(content))).withColumn("digest", full_digest(F.col(content))).drop(content)


def first_copies(stream: DataFrame, time: str = "arrived", delay: str = "1 hour") -> DataFrame:
    """Each content's first row; state is kept for the watermark's delay only."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(["size", "digest"])


def copies_by_window(stream: DataFrame, time: str = "arrived", delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """window, size, digest, copies and wasted of the contents that arrived more than once in a window."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width), "size", "digest").agg(F.count("*").alias("copies"))
    return counted.filter("copies >= 2").withColumn("wasted", F.col("size") * (F.col("copies") - 1))
