"""Vectors on an integer grid, which the operators on codes and on hard negatives share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Components beyond this many grid steps count as this many, so that sums of squares stay within 64 bits.
FARTHEST = 1 << 24


def finite(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def grid(vector: Column, steps: int = 256) -> Column:
    """floor(steps * x) of every component, as int."""
    within = lambda x: F.greatest(F.least(F.floor(x * float(steps)), F.lit(FARTHEST)), F.lit(-FARTHEST)).cast("int")
    return F.transform(vector.cast("array<double>"), within)


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The non-null lists, all of ``width`` numbers, as rows."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists) - lists.null_count, width)
