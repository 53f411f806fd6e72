"""Breach counts of a live trace: samples above a voltage in event-time windows, late samples up to the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breach_counts(stream: DataFrame, voltage: float, width: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(channel, start, breaches, n) for a stream of (channel, ts, v); the same on a table that is not a stream."""
    window = F.window("ts", width)
    counts = stream.withWatermark("ts", late).groupBy("channel", window.alias("w")).agg(F.count_if(F.col("v") > voltage).alias("breaches"), F.count("*").alias("n"))
    return counts.select("channel", F.col("w.start").alias("start"), "breaches", "n")
