"""Structured Streaming: category shares per window, to compare with a frozen reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_shares(stream: DataFrame, ts: str, category: str, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, category, n) per tumbling window; rows later than the watermark are left out."""
    d = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return d.groupBy(F.window(ts, window).alias("w"), F.col(category).alias("category")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "category", "n")
