"""Latest-per-key, top-k, ordered string lists and row ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.session import materialize


def latest(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows per key. Each task drops the rest before the shuffle, so hot keys shrink."""
    name = rank or "_latest"
    window = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


def rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Position inside a result list."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def ordered_join(df: DataFrame, keys: list[str], value: str, position: str, name: str, sep: str = ", ") -> DataFrame:
    """One text per key from few ranked rows."""
    pairs = F.array_sort(F.collect_list(F.struct(position, value)))
    joined = F.array_join(F.transform(pairs, lambda p: p[value]), sep)
    return df.groupBy(*keys).agg(joined.alias(name))


def top_ids(
    df: DataFrame, keys: list[str], id_col: str, ts_col: str, name: str, n: int = 3, sep: str = ", "
) -> DataFrame:
    """The ``n`` newest ids per key as one text; only ``n`` rows per key and task are shuffled."""
    narrow = df.select(*keys, F.col(id_col).alias("_id"), F.col(ts_col).alias("_ts"))
    newest = [F.col("_ts").desc(), F.col("_id").desc()]
    few = latest(narrow, keys, newest, n, "_rank").withColumn("_id", F.col("_id").cast("string"))
    return ordered_join(few, keys, "_id", "_rank", name, sep)


def distinct_join(
    df: DataFrame, keys: list[str], value: str, name: str, count_name: str | None = None,
    sep: str = ", ", inline: int | None = None,
) -> DataFrame:
    """Distinct values per key, sorted and joined.

    The distinct (key, value) pairs are counted by a spread-out shuffle. All values are joined unless the
    caller asks for the first ``inline``; ``count_name`` always counts all of them and :func:`distinct_pairs`
    lists them as rows.
    """
    pairs = distinct_pairs(df, keys, value)
    shown = pairs if inline is None else latest(pairs, keys, [F.col(value).asc()], inline)
    joined = sorted_join(shown, keys, value, name, sep)
    if count_name is None:
        return joined
    return pairs.groupBy(*keys).agg(F.count("*").alias(count_name)).join(joined, keys)


def sorted_join(df: DataFrame, keys: list[str], value: str, name: str, sep: str = ", ") -> DataFrame:
    """All values per key as one sorted text, one value at most for each row of the key."""
    values = F.array_sort(F.collect_list(F.col(value).cast("string")))
    return df.groupBy(*keys).agg(F.array_join(values, sep).alias(name))


def distinct_pairs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()


def span(col: str, prefix: str) -> list[Column]:
    return [F.min(col).alias(f"first_{prefix}"), F.max(col).alias(f"last_{prefix}")]


def ranged(df: DataFrame, order: list[str], partitions: int | None = None, name: str = "ranged") -> DataFrame:
    """Rows in ranges of ``order``, written once: ``_part`` is the range, ``_at`` the place in it from 0.

    Rows that are equal in ``order`` share a range, whatever their number.
    """
    ranges = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = ranges.sortWithinPartitions(*order).select(
        "*",
        F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"),
    )
    return materialize(placed, name, "zstd")


def surrogate_id(df: DataFrame, order: list[str], name: str, start: int = 1, partitions: int | None = None) -> DataFrame:
    """Consecutive ids in key order, without a window over the whole table.

    Rows are range-partitioned and sorted, written once, and each partition gets the number of rows
    before it. Only one count per partition is gathered. Equal keys are spread by a random number, so that copies of one
    key do not share a task.
    """
    spread = df.withColumn("_spread", F.rand(seed=1))
    placed = ranged(spread, [*order, "_spread"], partitions, "ids").drop("_spread")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    numbered = placed.join(F.broadcast(offsets), "_part")  # a row for each partition
    return numbered.withColumn(name, F.col("_offset") + F.col("_at") + F.lit(start)).drop(
        "_part", "_at", "_offset"
    )
