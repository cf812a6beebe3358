"""Broadcast behind a check of size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a narrow table is sent to every executor.
SMALL_ROWS = 200_000


def small(rows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The rows, marked for a broadcast if there are at most ``limit`` of them; counting stops
    there, and a larger table is left to a shuffled join."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows
