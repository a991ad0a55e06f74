"""Nearest neighbours by a block matrix join.

Vectors are dealt into blocks. A tile multiplies a block of queries by a block of candidates in 8-bit integers; with
x' the quantised x, Cauchy and Schwarz bound the error: |x.y - x'.y'| <= |x - x'| |y| + |x'| |y - y'|. A candidate whose
upper bound lies below the k-th largest lower bound of its tile cannot be among the k nearest there. The others are
computed again in double precision, and the tiles' lists are merged by heaps. The result is exact.
"""

from __future__ import annotations

import heapq
import math
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.session import materialize

BLOCK, QUERY_BLOCK = 1 << 14, 1 << 16  # candidates and queries in a block
LEAST_BLOCK = 2048  # smaller tables are not cut further to occupy all cores
STRIP = 256  # queries multiplied at once
FAN_IN = 64  # lists of a query that meet in one merge


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0)


class Block:
    """Vectors with their quantised form, its scale, and what the error bound needs."""

    def __init__(self, frame: pd.DataFrame, side: str):
        frame = frame.sort_values([f"{side}_id", f"{side}_row"])
        self.ids, self.rows = frame[f"{side}_id"].to_numpy(), frame[f"{side}_row"].to_numpy()
        self.exact = np.stack(frame[f"{side}_vector"].to_numpy()).astype(np.float64)
        self.scale = np.abs(self.exact).max(axis=1, keepdims=True) / 127
        self.small = np.rint(self.exact / self.scale).astype(np.int8)
        self.norm = np.linalg.norm(self.exact, axis=1)
        quantised = self.small * self.scale
        self.small_norm = np.linalg.norm(quantised, axis=1)
        self.error = np.linalg.norm(self.exact - quantised, axis=1)

    def products(self, other: "Block") -> np.ndarray:
        # Sums of 8-bit products stay below 2**24 up to 1040 dimensions: exact in single precision.
        kind = np.float32 if self.small.shape[1] <= 1040 else np.float64
        return self.small.astype(kind) @ other.small.T.astype(kind)

    def strips(self):
        for at in range(0, len(self.ids), STRIP):
            part = object.__new__(Block)
            part.__dict__ = {name: value[at : at + STRIP] for name, value in self.__dict__.items()}
            yield part


def nearest_in_tile(queries: Block, candidates: Block, k: int):
    """For each query of a strip its k nearest candidates in order: (query row, query id, ids, scores)."""
    rough = queries.products(candidates).astype(np.float64) * queries.scale * candidates.scale.T
    error = np.outer(queries.error, candidates.norm) + np.outer(queries.small_norm, candidates.error)
    error += 1e-12 * np.outer(queries.norm, candidates.norm)  # rounding of the bounds themselves
    own = queries.rows[:, None] == candidates.rows[None, :]
    low = np.where(own, -np.inf, rough - error)
    if low.shape[1] > k:
        limit = np.partition(low, -k, axis=1)[:, -k][:, None]
    else:
        limit = np.full((len(low), 1), -np.inf)
    q, c = np.nonzero((rough + error >= limit) & ~own)
    scores = np.empty(len(q))
    for at in range(0, len(q), 1 << 16):
        s = slice(at, at + (1 << 16))
        # added up from the first component to the last
        scores[s] = np.cumsum(queries.exact[q[s]] * candidates.exact[c[s]], axis=1)[:, -1]
    ids = candidates.ids[c]
    order = np.lexsort((ids, -scores, q))
    ends = np.searchsorted(q[order], np.arange(len(queries.ids) + 1))
    for i, (a, b) in enumerate(zip(ends, ends[1:])):
        best = order[a : min(b, a + k)]
        yield queries.rows[i], queries.ids[i], ids[best], scores[best]


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, <id>, score): the ``k`` candidates of largest inner product for each query, ties to the smaller id.

    Every usable vector is a candidate but for the query's own row; queries with fewer candidates get all. Unusable
    vectors and null ids take no part. Rows that share an id are rows of their own: each is a candidate of the others, and
    each that is a query gets its own list. Vectors meet those of their own dimension only; components of any size may
    occur. An empty table gives no rows. A task holds a block of either side and a strip of their products; a vector moves
    once for each block of the other side.
    """
    slim = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    slim = slim.where(usable(F.col("vector")) & F.col("id").isNotNull())
    slim = materialize(slim.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}), "vectors")
    total, asking = slim.agg(F.count("*"), F.count_if("query")).first()
    spread = min(slim.sparkSession.sparkContext.defaultParallelism, math.ceil(total / LEAST_BLOCK))
    c_blocks, q_blocks = max(1, math.ceil(total / block), spread), max(1, math.ceil(asking / query_block))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = slim.withColumn("c", deal(c_blocks)).withColumn("q", every(q_blocks))
    left = slim.where("query").withColumn("q", deal(q_blocks)).withColumn("c", every(c_blocks))

    def tile(key: tuple, queries: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(candidates):
            against = Block(candidates, "c")
            for strip in Block(queries, "q").strips():
                rows += [(key[0], key[1], *found) for found in nearest_in_tile(strip, against, k)]
        return pd.DataFrame(rows, columns=["q", "c", "query_row", "query_id", "ids", "scores"])

    schema = "q int, c int, query_row long, query_id long, ids array<long>, scores array<double>"
    keys = ["q", "c", "dim"]
    left, right = (
        side.select(
            *(F.col(key).alias(key) for key in keys), F.col("row").alias(f"{name}_row"), F.col("id").alias(f"{name}_id"), F.col("vector").alias(f"{name}_vector")
        )
        for name, side in (("q", left), ("c", right))
    )
    lists = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(tile, schema)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for (row, query), own in group.groupby(["query_row", "query_id"]):
            best = islice(heapq.merge(*(zip(-s, i) for s, i in zip(own["scores"], own["ids"]))), k)
            scores, ids = zip(*best) if any(map(len, own["ids"])) else ((), ())
            rows.append((key[0], key[1], row, query, list(ids), [-s for s in scores]))
        return pd.DataFrame(rows, columns=["q", "c", "query_row", "query_id", "ids", "scores"])

    while c_blocks > 1:
        c_blocks = math.ceil(c_blocks / FAN_IN)
        # Lists of a block of queries meet by a part of its rows, so that no group holds a whole block's lists.
        lists = lists.withColumn("c", F.floor(F.col("c") / FAN_IN).cast("int")).withColumn("part", F.pmod(F.xxhash64("query_row"), F.lit(64)))
        lists = lists.groupBy("q", "c", "part").applyInPandas(merge, schema)
    found = lists.select("query_id", F.posexplode(F.arrays_zip("ids", "scores")).alias("place", "hit"))
    return found.select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.ids").alias(id), F.col("hit.scores").alias("score")
    )
