"""The event log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, kind: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events of each kind in tumbling windows; events later than late are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, length).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
