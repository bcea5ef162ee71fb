"""Broadcasts behind a size check, and partitions by the number of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000

#: Rows of a narrow table that one task sorts or groups, with what it makes of each.
TASK_ROWS = 50_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a table of narrow rows counted to be small; a larger one keeps Spark's own choice of join.

    The count stops at the limit.
    """
    return F.broadcast(df) if is_small(df, rows) else df


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def tasks_for(df: DataFrame) -> int:
    """Partitions that hold TASK_ROWS rows each on average, at least one per core. Counts the rows."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // TASK_ROWS))
