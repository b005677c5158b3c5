"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Marks a class, month or parameter table for broadcast if it has at most ``most`` rows; a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
