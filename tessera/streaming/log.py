"""The prediction log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(stream: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Predictions by window and model; rows later than ``late`` are left out."""
    return stream.withWatermark("created_at", late).groupBy(F.window("created_at", size), "model").agg(F.count("*").alias("n"), F.avg("confidence").alias("avg_confidence"))


def once(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each input once within the watermark."""
    return stream.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["input_hash"])
