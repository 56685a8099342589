"""Votes that arrive as a stream: running sums, and windows of event time with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scenelake.operators.voting import KEYS


def running_votes(stream: DataFrame) -> DataFrame:
    """Summed weight and count per (frame, instance, point) over all that has arrived; for update or complete mode."""
    return stream.groupBy(*KEYS, "gaussian_index").agg(F.sum("weight").alias("weight"), F.count("*").alias("votes"))


def windowed_counts(stream: DataFrame, time: str, by: str, *, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by, n) per tumbling window; rows later than the watermark are dropped and closed windows emitted once in append mode."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("start"), by, "n")
