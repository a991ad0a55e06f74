"""SimHash near-duplicates with pivot distance tables.

A fingerprint links to another at a few differing bits. Its row of the pivot table holds its Hamming distances to
reference fingerprints: zero, the 64 single bits, and random ones. By the triangle inequality, no coordinate of two
linked rows differs by more than the bit distance, so a pair with a larger coordinate difference is discarded.

The single-bit references also say which pairs to look at. The distances to zero and to bit i differ by +1 or -1, as
bit i is clear or set, so rows of linked fingerprints disagree about at most ``max_bits`` of the single-bit
references. Dealt into ``max_bits + 3`` blocks of bits, they agree about three whole blocks at least. The part of the
table that belongs to three blocks is therefore the join key, once for each choice of three blocks.

The distances to the random references are worked out once for each fingerprint and travel with it. Members of one cell
are compared in tiles of bounded size, ordered by the first of these distances: a member only meets those whose first
distance is at most ``max_bits`` larger, the other distances discard more pairs, and the bits decide about the rest. A tile
gives each member a link to the smallest fingerprint that it reaches there, never all pairs. Links become components by
alternating large and small stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.tables import LOWER, spare
from lodestone.session import broadcast_if_small, materialize

SEED = 42  # of the hash in the contract, and of the random references
REFERENCES = np.random.default_rng(SEED).integers(0, 2**64, 8, dtype=np.uint64)
TILE = 2048  # members of a cell that meet in one tile, twice
LINKS = 2_000_000  # links held in a task before they are merged


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, in slices of bounded memory."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: str | None, width: int = 3) -> int:
    """Signed 64-bit fingerprint of the word shingles; null and blank texts have 0."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    bits = np.packbits(2 * bit_sums(hashes) > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(id, fp) of every row, from whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["id"].to_numpy(dtype=object, na_value=None)
            yield pd.DataFrame({"id": ids, "fp": np.array([fingerprint(t, width) for t in batch["text"]], np.int64)})

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, fp long")


def cell_keys(fp: Column, max_bits: int) -> Column:
    """The keys of a fingerprint: the number of a choice of three blocks of bits, and those blocks."""
    n = max_bits + 3
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    keys = []
    for k, chosen in enumerate(combinations(range(n), 3)):
        mask = sum(masks[i] for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.struct(F.lit(k).cast("smallint").alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("bits")))
    return F.array(*keys)


def pivot_row(fp: Column) -> Column:
    """Hamming distances of a fingerprint to the random references, a byte each."""
    distance = lambda r: F.bit_count(fp.bitwiseXOR(F.lit(int(r.astype(np.int64))))).cast("long")
    row = F.lit(0).cast("long")
    for i, reference in enumerate(REFERENCES):
        row = row.bitwiseOR(F.shiftleft(distance(reference), 8 * i))
    return row


def smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) reach."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, label[a], low)
        np.minimum.at(after, label[b], low)
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == label).all():
            return label
        label = after


def tile_links(group: np.ndarray, fps: np.ndarray, pivots: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of runs of equal ``group``, and the smallest member each reaches by links inside its run.

    ``pivots`` are rows of the pivot table; inside a run members are ordered by their first coordinate.
    """
    table = pivots.view(np.uint8).reshape(-1, 8).astype(np.int16)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.repeat(np.r_[starts[1:], len(group)], np.diff(np.r_[starts, len(group)]))
    left, right, held = [], [], 0
    active, shift = np.arange(len(group)), 0

    def merged() -> np.ndarray:
        if not left:
            return np.arange(len(group))
        return smallest_reachable(len(group), np.concatenate(left), np.concatenate(right))

    while True:
        shift += 1
        active = active[active + shift < ends[active]]
        # Later members are farther from the first reference still.
        active = active[table[active + shift, 0] - table[active, 0] <= max_bits]
        if not len(active):
            break
        other = active + shift
        near = np.abs(table[active] - table[other]).max(axis=1) <= max_bits
        i, j = active[near], other[near]
        linked = np.bitwise_count(fps[i] ^ fps[j]) <= max_bits
        left.append(i[linked])
        right.append(j[linked])
        held += int(linked.sum())
        if held > LINKS:
            label = merged()
            left, right, held = [np.arange(len(group))], [label], 0
    label = merged()
    moved = np.flatnonzero(label != np.arange(len(group)))
    return moved, label[moved]


def links(fps: DataFrame, max_bits: int = 3, tile: int = TILE) -> DataFrame:
    """(a, b): each fingerprint of ``fps`` (distinct, column fp) with fingerprints that it reaches by links, enough of
    them to keep every component whole."""
    keyed = fps.select("fp", pivot_row(F.col("fp")).alias("pivots"), F.explode(cell_keys(F.col("fp"), max_bits)).alias("key"))
    keyed = keyed.select("fp", "pivots", F.col("key.choice").alias("choice"), F.col("key.bits").alias("bits"))
    # Cells of one member have no pair. Larger cells are cut into tiles, each with the members of two parts.
    cells = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / tile).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    tiles = (
        keyed.join(cells, ["choice", "bits"])
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("choice", "bits", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp", "pivots")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, carry = ["choice", "bits", "lo", "hi"], None

        def linked(frame: pd.DataFrame) -> pd.DataFrame:
            group = (frame[names] != frame[names].shift()).any(axis=1).cumsum().to_numpy()
            values = frame["fp"].to_numpy()
            member, root = tile_links(group, values.view(np.uint64), frame["pivots"].to_numpy(np.int64), max_bits)
            return pd.DataFrame({"a": values[member], "b": values[root]})

        for batch in batches:
            if not len(batch):
                continue
            batch = batch if carry is None else pd.concat([carry, batch], ignore_index=True)
            same = (batch[names] == batch[names].iloc[-1]).all(axis=1).to_numpy()
            yield linked(batch[~same])  # the last tile may go on in the next batch
            carry = batch[same]
        if carry is not None:
            yield linked(carry)

    first = F.col("pivots").bitwiseAND(F.lit(255))
    dealt = tiles.repartition("choice", "bits", "lo", "hi").sortWithinPartitions("choice", "bits", "lo", "hi", first)
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node of its component.

    Alternates large and small stars; a round's edges are written, so that the lineage stays short and no round is
    computed twice. Rounds grow with the logarithm of the longest chain.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), "links")
    before = None
    while True:
        # Large stars: neighbours above a node go to the smallest node around it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small stars: a node and the neighbours below it go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))
        )).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = materialize(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def grouped(docs: DataFrame, id: str, text: str, width: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of every row, written; and fp, id, root and component_id of every row. The root names the component."""
    rows = materialize(fingerprints(docs, id, text, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("low"))
    found = components(links(nodes.select("fp"), max_bits)).withColumnsRenamed({"node": "fp"})
    linked = nodes.join(found, "fp")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "root").select("fp", "root", "component_id")
    nodes = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id")
    )
    # Written, so that the join below is one of two plain shuffles, whose hot partitions Spark can split.
    return rows, rows.join(materialize(nodes, "components"), "fp")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """One row for each row of ``docs``: the id, fingerprint (16 hex digits) and component_id, the smallest id that
    links of at most ``max_bits`` differing bits reach, its own included.

    Equal fingerprints are one node, so groups of copies cost nothing beyond their fingerprint. Null and blank texts
    share fingerprint 0. A row without an id gets the smallest id of its component, null if that has none. An empty
    table gives no rows.
    """
    _, out = grouped(docs, id, text, width, max_bits)
    return out.select(F.col("id").alias(id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of each component, that of the smallest id, with the columns of ``docs``. Of rows of the component that
    share this id, the smallest fingerprint's stays, one of them; rows of other components that share it are theirs. Rows
    without an id give way to rows with one; of a component without any id, one row of the smallest fingerprint stays.
    Where rows of one id and fingerprint compete, hashes of their columns decide, so that a repeated run keeps the same."""
    rows, groups = grouped(docs, id, text, width, max_bits)
    winners = groups.where("id = component_id").groupBy("root").agg(F.min("fp").alias("fp"), F.min("id").alias("id"))
    winners = materialize(winners.select("id", "fp"), "winners")
    # An id that several rows share says too little about a row; the fingerprint is worked out again for their rows only.
    several = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    several = materialize(winners.join(several, "id", "left_semi"), "several")
    nameless = groups.where("component_id is null").groupBy("root").agg(F.min("fp").alias("fp")).select("fp")
    nameless = materialize(nameless, "nameless")
    key, fp = F.col("id").alias(id), spare(docs, "fp")
    again = F.pandas_udf(lambda texts: pd.Series([fingerprint(t, width) for t in texts], dtype="int64"), "long")
    order = F.struct(F.xxhash64(text), F.xxhash64(*(F.col(c) for c, kind in docs.dtypes if "map<" not in kind)))

    def first(some: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """One row for each of the wanted keys."""
        marked = some.withColumn(fp, again(F.col(text))).join(broadcast_if_small(wanted), keys, "left_semi")
        best = marked.groupBy(*(F.col(c).alias(f"key{i}") for i, c in enumerate(keys))).agg(F.min_by(F.struct(*docs.columns), order).alias("row"))
        return best.select("row.*")

    if several.isEmpty():
        kept = docs.join(winners.select(key), id, "left_semi").select(*docs.columns)
    else:
        single = winners.join(several, "id", "left_anti").select(key)
        kept = docs.join(single, id, "left_semi").select(*docs.columns)
        shared = docs.join(broadcast_if_small(several.select(key).distinct()), id, "left_semi")
        kept = kept.unionByName(first(shared, several.select(key, F.col("fp").alias(fp)), [id, fp]))
    if not nameless.isEmpty():
        kept = kept.unionByName(first(docs.where(F.col(id).isNull()), nameless.select(F.col("fp").alias(fp)), [fp]))
    return kept
