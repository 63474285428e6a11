"""Token counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(stream: DataFrame, at: str, token: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """(window, token, n) of a stream with event times; rows later than the watermark are dropped."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), token).agg(F.count("*").alias("n"))
