"""Broadcast only what is small, as far as the plan knows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest estimated size of a side that is broadcast.
MOST_BYTES = 48 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; it is huge where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its estimated size is bounded; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if estimated_bytes(df) <= MOST_BYTES else df
