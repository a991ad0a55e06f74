"""Guards and check rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def require_nonempty(df: DataFrame, message: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(message)
    return df


def union_rows(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
