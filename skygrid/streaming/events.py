"""Streaming forms of two operators: first arrival of a key, and counts in half-hour slots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Each key once while the watermark remembers it."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def slot_counts(stream: DataFrame, at: str, kind: str, late: str = "1 hour", slot: str = "30 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, slot).alias("_w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("slot_start"), kind, "n")
