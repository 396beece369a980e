"""Streams over a ledger folder: best gains so far, and a bounded de-duplication of late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_gains(rows: DataFrame) -> DataFrame:
    """Per (unit, symbol) the largest gain; a complete or update-mode aggregation of a ledger stream."""
    gain = F.col("after") - F.col("before")
    return rows.where(gain > 0).groupBy("unit", "symbol").agg(F.max(gain).alias("gain"), F.count(F.lit(1)).alias("n_rows"))


def once(rows: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Drop rows that repeat their keys within the watermark; state older than ``delay`` is forgotten."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def hourly(rows: DataFrame, time: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Tumbling one-hour counts and sums with late data up to ``delay``."""
    return rows.withWatermark(time, delay).groupBy(F.window(time, "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
