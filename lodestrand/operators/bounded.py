"""Broadcasts of proven size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 200_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `most` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
