"""CSV records with line breaks inside quotes, read by many tasks for each file.

Lines are read as text, which Spark splits anywhere. Whether a line starts inside a quoted field depends on all lines before
it, so every line is taken as a function from that state to the state after it; a line of text alone decides the function.
A first pass composes the functions of each split, a window over the splits (one row each) composes those, and a second
pass, which knows the state at the start of its split, cuts records where they begin. Pieces of a record that crosses splits
meet by the split in which it began.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from lodestone.session import broadcast_if_small, materialize

# A quote opens a field only at its start; inside, two quotes are one. All loops are possessive: no backtracking.
_INSIDE = r'(?:[^"]++|"")*+'
_FIELDS = rf'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+|),)*+'
_OPEN = rf'"{_INSIDE}$'
OPTIONS = {"quote": '"', "escape": '"', "emptyValue": "", "multiLine": "true", "maxCharsPerColumn": "-1"}


def opens(line: Column) -> Column:
    """A line that starts outside quotes ends inside."""
    return line.contains('"') & line.rlike(rf"(?s)^{_FIELDS}{_OPEN}")


def stays(line: Column) -> Column:
    """A line that starts inside quotes ends inside, in the same field or in another."""
    return ~line.contains('"') | line.rlike(rf'(?s)^{_INSIDE}$') | line.rlike(rf'(?s)^{_INSIDE}"[^,]*+,{_FIELDS}{_OPEN}')


def after(opens: np.ndarray, stays: np.ndarray, inside: bool) -> np.ndarray:
    """The state after each line, given that before the first."""
    fixed, swaps = opens == stays, np.cumsum(opens & ~stays)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(opens)), -1))
    base = np.where(last >= 0, opens[last], inside)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return base ^ (since % 2 == 1)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of stretches of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)])


def _flags(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opens", "stays", "blank")]


def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split and either state at its start: the state at its end, and the records that start in it."""
    current, out = None, []

    def done() -> None:
        if current is not None:
            out.append((*current["at"], bool(current["end"][0]), bool(current["end"][1]), *current["starts"]))

    for batch in batches:
        if not batch.num_rows:
            continue
        path = batch.column("path").dictionary_encode()
        block = batch.column("block").to_numpy()
        codes = path.indices.to_numpy()
        flags = _flags(batch)
        for a, b in runs(codes * np.int64(1 << 45) + block):
            at = (path.dictionary[int(codes[a])].as_py(), int(block[a]))
            if current is None or current["at"] != at:
                done()
                current = {"at": at, "end": [False, True], "starts": [0, 0]}
            opening, staying, blank = (f[a:b] for f in flags)
            for start in (0, 1):
                states = after(opening, staying, current["end"][start])
                before = np.concatenate([[current["end"][start]], states[:-1]])
                current["starts"][start] += int((~before & ~blank).sum())
                current["end"][start] = bool(states[-1])
    done()
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("path", "block", "end_out", "end_in", "starts_out", "starts_in"), map(list, zip(*out)))))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of records: place in the split (-1: the rest of a record that began before), text, whether it is cut off."""
    split, inside, at, held = None, False, 0, None  # held: lines of the record that is not ended yet, with its place

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["split", "at", "text", "cut"]
        )

    for batch in batches:
        rows: list[tuple] = []
        if not batch.num_rows:
            continue
        number, starts = batch.column("split").to_numpy(), batch.column("inside").to_numpy(zero_copy_only=False)
        lines, flags = batch.column("value").to_pylist(), _flags(batch)
        for a, b in runs(number):
            if split != number[a]:
                if held:
                    rows.append((split, held[0], "\n".join(held[1]), True))
                split, inside, at = int(number[a]), bool(starts[a]), 0
                held = (-1, []) if inside else None
            opening, staying, blank = (f[a:b] for f in flags)
            states = after(opening, staying, inside)
            before = np.concatenate([[inside], states[:-1]])
            for i in np.flatnonzero(before | states | ~blank).tolist():
                if not before[i]:
                    held = (at, [])
                    at += 1
                held[1].append(lines[a + i])
                if not states[i]:
                    rows.append((split, held[0], "\n".join(held[1]), False))
                    held = None
            inside = bool(states[-1])
        yield batch_of(rows)
    if held:
        yield batch_of([(split, held[0], "\n".join(held[1]), True)])


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(source_row, text) of every record but the files' first, numbered from 2 over all files in the order of their paths.

    Lines end in line feeds, after which carriage returns may stand. Empty lines between records do not count. An opened
    quote that nothing closes runs to the end of its file.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value",
        opens(F.col("value")).alias("opens"), stays(F.col("value")).alias("stays"), F.col("value").isin("", "\r").alias("blank"),
    )
    found = lines.drop("value").mapInArrow(
        summarise, "path string, block long, end_out boolean, end_in boolean, starts_out long, starts_in long"
    )
    in_file = Window.partitionBy("path").orderBy("block")
    splits = materialize(found, "splits").withColumn("fixed", F.col("end_out") == F.col("end_in"))
    splits = splits.withColumn("group", F.sum(F.col("fixed").cast("long")).over(in_file))
    in_group = Window.partitionBy("path", "group").orderBy("block")
    swaps = F.sum((~F.col("fixed") & F.col("end_out")).cast("long")).over(in_group) % 2 == 1
    base = F.coalesce(F.first(F.when(F.col("fixed"), F.col("end_out")), ignorenulls=True).over(in_group), F.lit(False))
    splits = splits.withColumn("end", base != swaps)
    splits = splits.withColumn("inside", F.lag("end", 1, False).over(in_file))
    splits = splits.withColumn("starts", F.when(F.col("inside"), F.col("starts_in")).otherwise(F.col("starts_out")))
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("starts").over(before), F.lit(0)))
    # One row a file and one a split: the only windows without a key.
    files = splits.groupBy("path").agg(F.sum("starts").alias("records"))
    earlier = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("base", F.coalesce(F.sum(F.greatest(F.col("records") - 1, F.lit(0))).over(earlier), F.lit(0)))
    splits = splits.join(files, "path").withColumn("split", F.row_number().over(Window.orderBy("path", "block")).cast("long"))
    owner = F.last(F.when(F.col("starts") > 0, F.col("split")), ignorenulls=True).over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    splits = materialize(splits.withColumn("owner", owner).select("path", "block", "split", "inside", "before", "base", "owner"), "splits")

    placed = lines.join(broadcast_if_small(splits.select("path", "block", "split", "inside")), ["path", "block"])
    pieces = materialize(placed.select("split", "inside", "value", "opens", "stays", "blank").mapInArrow(cut, "split long, at long, text string, cut boolean"), "pieces")
    whole = pieces.where("at >= 0 and not cut").select("split", "at", "text")
    begun = pieces.where("at >= 0 and cut").select(F.col("split").alias("owner"), "split", "at", "text")
    rest = pieces.where("at < 0").join(splits.select("split", "owner"), "split").where("owner is not null").select("owner", "split", "at", "text")
    crossing = begun.unionByName(rest).groupBy("owner").agg(F.max("at").alias("at"), F.array_sort(F.collect_list(F.struct("split", "text"))).alias("parts"))
    crossing = crossing.select(F.col("owner").alias("split"), "at", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    numbered = whole.unionByName(crossing).join(broadcast_if_small(splits.select("split", "before", "base")), "split")
    numbered = numbered.where(F.col("before") + F.col("at") > 0)  # not the header
    return numbered.select((F.col("base") + F.col("before") + F.col("at") + 1).alias("source_row"), F.regexp_replace("text", "\r$", "").alias("text"))


def read(spark: SparkSession, path: str | list[str], schema: StructType) -> DataFrame:
    """The records' columns after their ``source_row``."""
    parsed = records(spark, path).select("source_row", F.from_csv("text", schema.simpleString(), OPTIONS).alias("fields"))
    return parsed.select("source_row", "fields.*")
