"""Vector codes: each part of a vector is replaced by the index of the nearest entry of a small codebook.

Codebooks are refined in rounds of assignment and mean. From the second assignment on, adaptive bounds after Drake and
Hamerly save most distances. A pass writes, for every part of every vector, its ``depth`` closest entries besides the
assigned one, each with a lower bound of its distance, and one outer bound for all remaining entries. When entries move,
the bounds shrink by the moves. A part whose exact distance to its entry lies below all its bounds keeps it; otherwise
the entries whose bounds do not clear that distance are measured again in integers; only where the outer bound fails are
all entries measured. Each batch adapts the depth it writes to what it needed. Bounds are floors of integers' roots, so
the result is the one of comparing everything.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.grid import finite, grid, matrix
from lodestone.session import materialize

FAR = (1 << 16) - 1  # the largest bound that is stored; a larger distance is still at least this
COVERED = 0.99  # share of re-measured parts that the next depth serves
SCANNED = 0.25  # share of parts measured against all entries beyond which a batch starts anew with deeper lists


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows to entries, exact, as int64."""
    if len(x) and (np.abs(x).max() + np.abs(entries).max()) ** 2 * max(1, x.shape[1]) < 1 << 52:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1) if len(x) else np.empty((0, len(entries)), np.int64)


def root_floor(d: np.ndarray) -> np.ndarray:
    root = np.floor(np.sqrt(d.astype(np.float64))).astype(np.int64)
    return np.minimum(root - (root * root > d), FAR)


def root_ceil(d: np.ndarray) -> np.ndarray:
    root = np.floor(np.sqrt(d.astype(np.float64))).astype(np.int64)
    root -= root * root > d
    return root + (root * root < d)


def scan(x: np.ndarray, entries: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Against all entries: (nearest, its squared distance, the next ``depth`` entries, their bounds and the outer one)."""
    n = len(entries)
    key = squares(x, entries) * n + np.arange(n)  # ties go to the lower index
    if depth + 2 < n:
        key = np.partition(key, np.arange(depth + 2), axis=1)[:, : depth + 2]
    else:
        key = np.sort(key, axis=1)
    outer = root_floor(key[:, depth + 1] // n) if depth + 1 < n else np.full(len(x), FAR)
    low = np.concatenate([root_floor(key[:, 1 : depth + 1] // n), outer[:, None]], axis=1)
    return key[:, 0] % n, key[:, 0] // n, key[:, 1 : depth + 1] % n, low


@dataclass
class Batch:
    """Assignments of a batch with the lists it carries: code and error by part, near and low by part and place."""

    code: np.ndarray
    error: np.ndarray
    near: np.ndarray
    low: np.ndarray

    @classmethod
    def fresh(cls, parts: np.ndarray, books: np.ndarray, depth: int) -> "Batch":
        found = [scan(parts[:, p], books[p], depth) for p in range(parts.shape[1])]
        return cls(*(np.stack(x, axis=1) for x in zip(*found)))

    def pack(self) -> list[bytes]:
        n, parts, depth = self.near.shape
        near = self.near.reshape(n, parts * depth).astype(np.uint8)
        low = np.ascontiguousarray(self.low.reshape(n, parts * (depth + 1)), dtype="<u2").view(np.uint8).reshape(n, 2 * parts * (depth + 1))
        return [row.tobytes() for row in np.concatenate([near, low], axis=1)]


def unpack(lists: list[bytes], parts: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(lists), np.uint8).reshape(len(lists), -1)
    cut = parts * depth
    low = np.ascontiguousarray(raw[:, cut:]).view("<u2")
    return raw[:, :cut].reshape(-1, parts, depth).astype(np.int64), low.reshape(-1, parts, depth + 1).astype(np.int64)


def again(parts: np.ndarray, code: np.ndarray, near: np.ndarray, low: np.ndarray, books: np.ndarray, moves: np.ndarray):
    """Assign anew from the lists of the last pass: (Batch, parts by number of entries needed, parts scanned).

    ``moves`` are upper bounds of how far each entry went, by part and entry.
    """
    n, count, _ = parts.shape
    depth, entries = near.shape[2], books.shape[1]
    needs, scans = np.zeros(depth + 1, np.int64), 0
    code, error, near = code.copy(), np.empty((n, count), np.int64), near.copy()
    low = low.copy()
    for p in range(count):
        x, book = parts[:, p].astype(np.int64), books[p]
        own = ((x - book[code[:, p]]) ** 2).sum(1)
        low[:, p, :depth] -= moves[p][near[:, p]]
        low[:, p, depth] = low[:, p, depth] - moves[p].max() if depth + 1 < entries else FAR
        # A bound counts for its place and all behind it.
        bound = np.minimum.accumulate(np.maximum(low[:, p], 0)[:, ::-1], axis=1)[:, ::-1]
        clear = bound * bound > own[:, None]
        if depth + 1 >= entries:
            clear[:, depth] = True
        need = (~clear).sum(1)  # places that do not clear the distance come first
        whole = np.flatnonzero(need > depth)
        some = np.flatnonzero((need > 0) & (need <= depth))
        low[:, p] = bound
        if len(some):
            k = int(need[some].max())
            ids = np.concatenate([code[some, p][:, None], near[some, p, :k]], axis=1)
            key = ((x[some][:, None, :] - book[ids]) ** 2).sum(2) * entries + ids
            key.sort(axis=1)
            code[some, p], own[some] = key[:, 0] % entries, key[:, 0] // entries
            near[some, p, :k], low[some, p, :k] = key[:, 1:] % entries, root_floor(key[:, 1:] // entries)
        if len(whole):
            code[whole, p], own[whole], near[whole, p], low[whole, p] = scan(x[whole], book, depth)
        error[:, p] = own
        needs += np.bincount(need[need <= depth], minlength=depth + 1)
        scans += len(whole)
    return Batch(code, error, near, low), needs, scans


def next_depth(depth: int, entries: int, needs: np.ndarray, scans: int) -> int:
    """Deeper where too many parts were scanned, else as deep as nearly all re-measured parts needed."""
    if scans > SCANNED * (needs.sum() + scans):
        return min(2 * depth, max(depth, entries // 4), entries - 1)
    served = np.cumsum(needs[1:])
    enough = 1 + int(np.searchsorted(served, COVERED * served[-1])) if len(served) and served[-1] else 1
    return max(min(depth, enough), min(depth, max(1, entries // 32)))


def shallower(batch: Batch, depth: int) -> Batch:
    """Shorter lists; the outer bound takes in those that go."""
    outer = batch.low[:, :, depth:].min(axis=2, keepdims=True)
    return Batch(batch.code, batch.error, batch.near[:, :, :depth], np.concatenate([batch.low[:, :, :depth], outer], axis=2))


PASS = """kept struct<{kept}>, grid array<int>, code binary, depth int, lists binary, error long,
    part int, entry int, members long, sums array<long>"""


def assigner(books: np.ndarray, moves: np.ndarray | None, depth: int, last: bool):
    """The function of a pass: rows with their new codes and lists, then a task's sums by part and entry.

    Rows of part -1 count parts: entry 0 kept without a comparison, 1 measured within their lists, 2 against all.
    """
    count, entries, width = books.shape

    def rows_of(batch: pa.RecordBatch, taking: np.ndarray, results: list) -> pa.RecordBatch:
        n = batch.num_rows
        columns = {name: [None] * n for name in ("code", "depth", "lists", "error")}
        for where, found in results:
            codes = found.code.astype(np.uint8)
            lists = None if last else found.pack()
            total = found.error.sum(1)
            for i, at in enumerate(taking[where]):
                columns["code"][at] = codes[i].tobytes()
                columns["error"][at] = int(total[i])
                if lists is not None:
                    columns["depth"][at], columns["lists"][at] = found.near.shape[2], lists[i]
        grid_column = pa.nulls(n, batch.column("grid").type) if last else batch.column("grid")
        return pa.RecordBatch.from_arrays(
            [
                batch.column("kept"), grid_column, pa.array(columns["code"], pa.binary()), pa.array(columns["depth"], pa.int32()),
                pa.array(columns["lists"], pa.binary()), pa.array(columns["error"], pa.int64()),
                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())),
            ],
            names=NAMES,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = np.zeros((count, entries), np.int64)
        sums = np.zeros((count, entries, width), np.int64)
        counts, types = np.zeros(3, np.int64), None
        for batch in batches:
            lists = batch.column("grid")
            types = batch.column("kept").type, lists.type
            taking = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            x = matrix(lists, count * width).reshape(-1, count, width).astype(np.int64)
            results = []
            if not len(x):
                pass
            elif moves is None:
                everything = np.arange(len(x))
                results.append((everything, Batch.fresh(x, books, depth)))
                counts[2] += x.shape[0] * count
            else:
                depths = batch.column("depth").drop_null().to_numpy(zero_copy_only=False)
                codes = np.frombuffer(b"".join(batch.column("code").drop_null().to_pylist()), np.uint8).reshape(-1, count).astype(np.int64)
                packed = batch.column("lists").drop_null().to_pylist()
                for own in np.unique(depths):
                    where = np.flatnonzero(depths == own)
                    near, low = unpack([packed[i] for i in where], count, int(own))
                    found, needs, scans = again(x[where], codes[where], near, low, books, moves)
                    counts += (needs[0], needs[1:].sum(), scans)
                    then = next_depth(int(own), entries, needs, scans)
                    if not last and then > own:
                        found = Batch.fresh(x[where], books, then)
                    elif not last and then < own:
                        found = shallower(found, then)
                    results.append((where, found))
            for where, found in results:
                for p in range(count):
                    members[p] += np.bincount(found.code[:, p], minlength=entries)
                    for j in range(width):
                        sums[p, :, j] += np.bincount(found.code[:, p], weights=x[where, p, j], minlength=entries).astype(np.int64)
            yield rows_of(batch, taking, results)
        if types is not None:
            part, entry = np.nonzero(members)
            n = len(part) + 3
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(n, types[0]), pa.nulls(n, types[1]), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()),
                    pa.array([*part, -1, -1, -1], pa.int32()), pa.array([*entry, 0, 1, 2], pa.int32()),
                    pa.array([*members[part, entry], *counts], pa.int64()),
                    pa.array([*sums[part, entry].tolist(), None, None, None], pa.list_(pa.int64())),
                ],
                names=NAMES,
            )

    return run


NAMES = ["kept", "grid", "code", "depth", "lists", "error", "part", "entry", "members", "sums"]


def moved(books: np.ndarray, sums: list, width: int) -> np.ndarray:
    """Every used entry becomes the floor of the mean of its parts, component by component."""
    new = books.copy()
    for row in sums:
        new[row["part"], row["entry"]] = [total // row["members"] for total in (row[f"s{j}"] for j in range(width))]
    return new


@dataclass
class Codes:
    """``rows``: the id, the kept columns, code (a byte a part) and error; ``books``: entries by part and index.

    ``work``: for each pass the parts kept without a comparison, measured within their lists, and against all entries.
    """

    rows: DataFrame
    books: np.ndarray
    work: list[tuple[int, int, int]]

    def digest(self) -> str:
        """SHA-256 of all entries' components in decimal, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()

    def decode(self, code: Column, steps: int = 256) -> Column:
        """The vector that a code stands for: the middle of each entry's grid cells."""
        books, width = self.books, self.books.shape[2]

        @F.pandas_udf("array<double>")
        def vectors(codes):
            import pandas as pd

            known = codes.notna()
            index = np.frombuffer(b"".join(codes[known]), np.uint8).reshape(-1, len(books))
            values = (books[np.arange(len(books)), index] + 0.5).reshape(len(index), len(books) * width) / steps
            out = pd.Series([None] * len(codes), index=codes.index, dtype=object)
            out[known] = pd.Series(list(values), index=codes.index[known], dtype=object)
            return out

        return vectors(code)


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, steps: int = 256, depth: int | None = None,
    id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ("label",),
) -> Codes:
    """Codes of all vectors without null or non-finite components; ties of distance go to the lower entry.

    Codebooks start as the parts of the ``entries`` (at most 256) rows of smallest id, null ids last, equal ids by vector;
    repeated rows count as often as they occur. The dimension is that of the first such row that can be cut into
    ``parts`` equal parts; rows of another dimension are kept with null code and error and take no part. Components
    count up to 65,536 in size (at 256 steps). Other columns than ``id`` and ``keep`` are left out, whatever their names.
    Fewer rows than ``entries`` give fewer entries; an empty table gives no rows. The driver holds the codebooks alone.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index must fit a byte")
    names = list(dict.fromkeys([id, *keep]))
    values = F.col(vector).cast("array<double>")
    rows = vectors.where(finite(values)).select(F.struct(*names).alias("kept"), grid(values, steps).alias("grid"))
    cuttable = rows.where((F.size("grid") > 0) & (F.size("grid") % parts == 0))
    order = [F.col("kept").getField(id).asc_nulls_last(), F.col("grid").asc()]
    first = cuttable.orderBy(*order).limit(entries).collect()
    if first and any(len(r["grid"]) != len(first[0]["grid"]) for r in first):
        first = cuttable.where(F.size("grid") == len(first[0]["grid"])).orderBy(*order).limit(entries).collect()
    if not first:
        empty = rows.select("kept.*", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
        return Codes(empty, np.empty((parts, 0, 0), np.int64), [])
    width = len(first[0]["grid"]) // parts
    books = np.array([r["grid"] for r in first], np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    depth = min(len(first) - 1, depth if depth is not None else max(2, entries // 16))
    schema = PASS.format(kept=", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema["kept"].dataType))
    table = rows.withColumn("grid", F.when(F.size("grid") == width * parts, F.col("grid")))
    moves, work = None, []
    for step in range(rounds + 1):
        written = materialize(table.mapInArrow(assigner(books, moves, depth, step == rounds), schema), "codes")
        sums = written.where("part is not null").groupBy("part", "entry").agg(
            F.sum("members").alias("members"), *(F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width))
        ).collect()  # an entry a row
        work.append(tuple(sum(r["members"] for r in sums if r["part"] == -1 and r["entry"] == kind) for kind in range(3)))
        table = written.where("part is null")
        if step < rounds:
            new = moved(books, [r for r in sums if r["part"] >= 0], width)
            moves = root_ceil(((new - books) ** 2).sum(2))
            books = new
    return Codes(table.select("kept.*", "code", "error"), books, work)
