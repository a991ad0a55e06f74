"""Hard negatives: for an anchor and one of its positives, the best rows of other labels in a window below the positive.

Blocks of rows meet blocks of anchors. Within a block, an inverted multi-index: both halves of the vectors have a codebook
of their own, and a row lies in the cell of its two nearest entries. With c an entry of radius r (the farthest of its
rows), a half h of an anchor scores at most h.c + |h| r there, and at least h.c - |h| r. A heap visits the cells of an
anchor by the sum of its two upper bounds, largest first. It stops when the next sum lies below the last place that each of
the anchor's windows still has to give; cells that lie above all windows are passed over. Scores are exact integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.llm.grid import finite, grid, matrix
from lodestone.session import materialize

BLOCK = 1 << 16  # rows or anchors of a block
STRIP = 512  # anchors that a task works on at once
SAMPLE = 2048  # rows of a block that its codebooks are fitted on; all rows are indexed
FITTINGS = 4
FIRST_CELLS = 8  # cells that an anchor visits before the first limit is known; twice as many each time after that
NO_ID = (1 << 63) - 1  # stands for a null id, which comes last
MOST = (1 << 63) - 1  # beyond any score


def fitted(half: np.ndarray, entries: int) -> np.ndarray:
    """Entries of a codebook, refined on an evenly spaced sample of the rows."""
    sample = half[:: max(1, -(-len(half) // SAMPLE))]
    centres = np.unique(sample, axis=0)
    centres = centres[np.linspace(0, len(centres) - 1, min(entries, len(centres))).astype(int)]
    for _ in range(FITTINGS):
        own = nearest(sample, centres)
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, sample)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(half: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(1) / 2
    return np.concatenate([(norms - half[at : at + 8192] @ centres.T).argmin(1) for at in range(0, len(half), 8192)])


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs of two lists of bounds, in descending order of the sums (multi-sequence)."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    x, y = first[a].tolist(), second[b].tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(-(x[0] + y[0]), 0, 0)]
    while heap:
        low, i, j = heapq.heappop(heap)
        yield -low, a[i], b[j]
        if j + 1 < len(y):
            heapq.heappush(heap, (-(x[i] + y[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(x):
            heapq.heappush(heap, (-(x[i + 1] + y[0]), i + 1, 0))


class MultiIndex:
    """The rows of a block by cell."""

    def __init__(self, row: np.ndarray, id: np.ndarray, label: np.ndarray, vectors: np.ndarray, entries: int):
        exact = vectors.astype(np.float64)
        cut = vectors.shape[1] // 2
        self.cut, self.books, self.radii, owners = cut, [], [], []
        for half in (exact[:, :cut], exact[:, cut:]):
            book = fitted(half, entries)
            own = nearest(half, book)
            away = np.sqrt(((half - book[own]) ** 2).sum(1))
            radius = np.zeros(len(book))
            np.maximum.at(radius, own, away)
            self.books.append(book)
            self.radii.append(radius)
            owners.append(own)
        self.width = len(self.books[1])
        cell = owners[0] * self.width + owners[1]
        order = np.argsort(cell, kind="stable")
        self.row, self.id, self.label, self.vectors = row[order], id[order], label[order], vectors[order]
        self.starts = np.searchsorted(cell[order], np.arange(len(self.books[0]) * self.width + 1)).tolist()
        self.norm = float(np.sqrt((exact * exact).sum(1).max()))
        self.forms: dict[type, np.ndarray] = {}

    def form(self, kind: type) -> np.ndarray:
        """The vectors as numbers in which a product with them is exact."""
        if kind not in self.forms:
            self.forms[kind] = self.vectors.astype(kind)
        return self.forms[kind]

    def bounds(self, anchors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """(upper, lower) by anchor and entry, for each half."""
        out = []
        for half, book, radius in zip((anchors[:, : self.cut], anchors[:, self.cut :]), self.books, self.radii):
            middle = half @ book.T
            norm = np.sqrt((half * half).sum(1))[:, None]
            # the last term covers the rounding of the bound itself
            reach = norm * radius + 1e-9 * norm * (np.sqrt((book * book).sum(1)) + radius) + 1e-9
            out.append((middle + reach, middle - reach))
        return out


def exact_kind(norms: float) -> type:
    """By Cauchy and Schwarz no partial sum of a product exceeds the product of the norms."""
    return np.float32 if norms < 1 << 23 else np.float64 if norms < 1 << 52 else np.int64


def best(index: MultiIndex, row: np.ndarray, label: np.ndarray, vectors: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
    """The first ``k`` rows of each window of each anchor: (anchor, window, id, score), and the rows scored.

    Windows are given by ``low`` and ``high``, by anchor and window; those with low > high are empty. ``same`` asks for
    rows of the anchor's own label but for itself, else for rows of another label.
    """
    anchors = vectors.astype(np.float64)
    (up1, down1), (up2, down2) = index.bounds(anchors)
    norm = float(np.sqrt((anchors * anchors).sum(1).max(initial=0)))
    kind = exact_kind(norm * index.norm)
    rows, asking = index.form(kind), vectors.astype(kind)
    floor = np.where(low <= high, low, MOST)  # what a further row must reach, by window
    top = np.where(low <= high, high, -MOST).max(axis=1)
    visits = [cells_by_bound(up1[i], up2[i]) for i in range(len(anchors))]
    active = [i for i in range(len(anchors)) if top[i] > -MOST]
    found = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)]  # anchor, place in the index, score
    kept_window = np.empty((0, 2), np.int64)
    wave, scored = FIRST_CELLS, 0
    while active:
        asked: dict[int, list[int]] = {}
        limit, going = floor.min(axis=1), []
        for i in active:
            taken, least, most = 0, limit[i], top[i]
            for bound, a, b in visits[i]:
                if bound < least:
                    break  # certified: no cell that is left can reach any window's last place
                cell = a * index.width + b
                if index.starts[cell] == index.starts[cell + 1] or down1[i, a] + down2[i, b] > most:
                    continue
                asked.setdefault(cell, []).append(i)
                taken += 1
                if taken == wave:
                    going.append(i)
                    break
        hits = []
        for cell, who in asked.items():
            start, end = index.starts[cell], index.starts[cell + 1]
            who = np.array(who)
            score = rows[start:end] @ asking[who].T
            scored += score.size
            alike = index.label[start:end, None] == label[who]
            fits = (score >= limit[who]) & (score <= top[who]) & (alike if same else ~alike)
            if same:
                fits &= index.row[start:end, None] != row[who]
            r, w = np.nonzero(fits)
            hits.append((who[w], r + start, score[r, w].astype(np.int64)))
        if hits:
            anchor, place, score = (np.concatenate([old, *new]) for old, new in zip(found, zip(*hits)))
            order = np.lexsort((index.id[place], -score, anchor))
            anchor, place, score = anchor[order], place[order], score[order]
            keep, windows = np.zeros(len(anchor), bool), []
            for w in range(low.shape[1]):
                inside = np.flatnonzero((score >= low[anchor, w]) & (score <= high[anchor, w]))
                rank = np.arange(len(inside)) - np.searchsorted(anchor[inside], anchor[inside])
                last = inside[rank == k - 1]
                floor[anchor[last], w] = score[last]
                inside = inside[rank < k]
                keep[inside] = True
                windows.append(np.stack([inside, np.full(len(inside), w)], axis=1))
            kept_window = np.concatenate(windows)
            new_place = np.cumsum(keep) - 1
            kept_window[:, 0] = new_place[kept_window[:, 0]]
            found = [anchor[keep], place[keep], score[keep]]
        active, wave = going, 2 * wave
    at, window = kept_window[:, 0], kept_window[:, 1]
    return found[0][at], window, index.id[found[1][at]], found[2][at], scored


FOUND = "anchor long, bar long, id long, score long"


def tile(k: int, same: bool, entries: int, low_share: int, high_share: int):
    """A function that searches a block of anchors in a block of rows; ``bar`` is the positive's score of a window."""

    def search(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out = [[np.empty(0, np.int64) for _ in range(4)]]
        if anchors.num_rows and rows.num_rows:
            width = anchors.column("dim")[0].as_py()
            number = lambda table, name: table.column(name).to_numpy()
            index = MultiIndex(number(rows, "row"), number(rows, "id"), number(rows, "label"), matrix(rows.column("grid"), width), entries)
            row, label, vectors = number(anchors, "row"), number(anchors, "label"), matrix(anchors.column("grid"), width)
            bars = anchors.column("bars").to_pylist()
            for at in range(0, len(row), STRIP):
                some = slice(at, at + STRIP)
                n = len(row[some])
                if same:
                    low, high = np.full((n, 1), 1 - MOST), np.full((n, 1), MOST)
                else:
                    widest = max(map(len, bars[some]))
                    low, high = np.ones((n, widest), np.int64), np.zeros((n, widest), np.int64)
                    for i, own in enumerate(bars[some]):
                        low[i, : len(own)] = [-(-low_share * bar // 100) for bar in own]
                        high[i, : len(own)] = [high_share * bar // 100 for bar in own]
                anchor, window, id, score, _ = best(index, row[some], label[some], vectors[some], low, high, k, same)
                bar = np.zeros(len(anchor), np.int64) if same else np.array([bars[at + a][w] for a, w in zip(anchor, window)], np.int64)
                out.append([row[some][anchor], bar, id, score])
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out)]
        return pa.table(columns, names=["anchor", "bar", "id", "score"])

    return search


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    entries: int = 16, block: int = BLOCK, steps: int = 256, id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for every anchor and positive.

    ``is_anchor`` and ``label`` (a whole number) are expressions over ``vectors``. Scores are inner products of
    floor(``steps`` * x), largest first, ties by smaller id, null ids last. The positives of an anchor are its first other
    rows of its label; the negatives of a positive with score p are the first rows of other labels whose score n has
    ``low`` * p <= 100 * n <= ``high`` * p. Rows with a null label, or a vector that is null or holds null or non-finite
    components, take no part; those of unlike dimension do not meet. Rows are told apart by row and not by id: a repeated
    anchor is mined as often as it occurs, and its copies are positives. Components count up to 65,536 in size (at 256
    steps); 2^63 - 1 is no id. Other columns are left out. An empty table gives no rows. A task holds two blocks.
    """
    narrow = vectors.select(
        F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        F.when(finite(F.col(vector).cast("array<double>")), grid(F.col(vector), steps)).alias("grid"),
    )
    narrow = narrow.where(F.col("label").isNotNull() & F.col("grid").isNotNull())
    rows = materialize(narrow.withColumns({"row": F.monotonically_increasing_id(), "dim": F.size("grid")}), "negatives")
    total, asking = rows.agg(F.count("*"), F.count_if("asks")).first()
    spread = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / SAMPLE))
    row_blocks = max(1, math.ceil(total / block), spread)
    anchor_blocks = max(1, math.ceil(asking / block))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    keys = ["a", "r", "dim"]

    def search(anchors: DataFrame, k: int, same: bool) -> DataFrame:
        tasks = row_blocks * anchor_blocks
        left = anchors.select("row", "label", "grid", "dim", "bars", deal(anchor_blocks).alias("a")).withColumn("r", every(row_blocks))
        right = rows.select("row", "id", "label", "grid", "dim", deal(row_blocks).alias("r")).withColumn("a", every(anchor_blocks))
        # columns of their own for each side, as both come from the same table
        left, right = (side.select(*(F.col(c).alias(c) for c in side.columns)).repartition(tasks, *keys) for side in (left, right))
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile(k, same, entries, low, high), FOUND)

    order = [F.col("score").desc(), F.col("id").asc()]
    anchors = rows.where("asks")
    pairs = search(anchors.withColumn("bars", F.array().cast("array<long>")), positives, True)
    pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("place") <= positives)
    pairs = materialize(pairs.select("anchor", "place", F.col("id").alias("positive"), F.col("score").alias("bar")), "positives")
    bars = pairs.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("bar").alias("bars"))  # at most ``positives`` each
    hits = search(anchors.join(bars, "row"), negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor", "bar").orderBy(*order))
    hits = hits.select("anchor", "bar", "id", "score", rank.alias("rank")).where(F.col("rank") <= negatives)
    named = rows.where("asks").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return pairs.join(hits, ["anchor", "bar"]).join(named, "anchor").select(
        back("anchor_id").alias("anchor_id"), back("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        back("id").alias("negative_id"), F.col("bar").alias("positive_score"), F.col("score").alias("negative_score"),
    )
