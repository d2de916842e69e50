"""Broadcast only with a proven size bound.

Without a bound the join is left to the planner: a shuffle join that AQE turns
into a broadcast when the materialised side is small at runtime, and whose
skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the largest row bound broadcast on a hint.
MAX_BROADCAST_ROWS = 100_000


def bounded_broadcast(df: DataFrame, row_bound: int | None, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    if row_bound is not None and row_bound <= max_rows:
        return F.broadcast(df)
    return df
