"""Data layout helpers: how rows are spread over tasks before heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows by near-unique keys; adaptive execution chooses the number of tasks.

    Aggregations on the keys that follow need no further shuffle.
    """
    return df.repartition(*[F.col(k) for k in keys])
