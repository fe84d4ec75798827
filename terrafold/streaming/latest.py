"""Latest-value state and one-time deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, time: str, *values: str) -> DataFrame:
    """The newest values of each key; works on a batch and, in update or complete mode, on a stream."""
    return rows.groupBy(key).agg(F.max_by(F.struct(time, *values), time).alias("_x")).select(key, "_x.*")


def once(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.dropDuplicates(list(keys))
