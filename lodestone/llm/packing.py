"""Best-two-fit packing of tokenized documents into sequences of bounded length.

A sequence is filled greedily, largest fitting document first. Then its smallest document is exchanged for two
unpacked ones, as long as two are found that fill the expanded gap more tightly.

Only lengths matter to this, and there are at most ``capacity`` of them. So the plan is made on the histogram of
lengths: sequences of equal make-up are planned together, as many as the counts allow. Exchanges use up the short
pieces that would fill the last sequences; so the plan's end is packed again by best-fit decreasing where that takes
fewer sequences. Every piece then finds its place from its rank among the pieces of its length, in parallel.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, Window, functions as F

from lodestone.llm.tables import shuffle_partitions
from lodestone.session import materialize

CAPACITY = 1024
END_ID = 2
LONG_RUN = 10_000  # blanks in a row
REMEMBERED = 64  # characters of the longest word that an encoder remembers
# The pre-tokenizer's pattern, spelled out for texts below U+0250: letters, digits and white space of that range.
_LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_DIGIT = r"0-9\xb2\xb3\xb9\xbc-\xbe"
_SPACE = r"\t-\r \x85\xa0"
NARROW = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^{_SPACE}{_LETTER}{_DIGIT}]+"
    rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
)


def added_tokens(path: str) -> dict[str, int]:
    """Id of each added token in the ``tokenizers`` file next to the ranks, none without such a file."""
    file = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(file):
        return {}
    with open(file, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    for token in listed:
        if any(token[flag] for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"only plain added tokens are matched, not {token}")
    return {token["content"]: token["id"] for token in listed}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes. Remembers the ids of up to ``room`` words, of REMEMBERED
    characters at most, so that unbroken runs do not fill a task's memory.

    ``path`` is a file of ranks, which hold the vocabulary of the ``tokenizers`` file of the same name; a test compares
    the ids. Tokens of ``added`` have their own id wherever they stand in a text, which is cut there; without them a text
    is words throughout. Texts with characters from U+0250 on go through the general pattern. The matcher of ``tiktoken`` fails on
    runs of a million blanks, so texts with long runs are cut into words here, which it then takes whole.
    """

    def __init__(self, path: str, room: int = 300_000, added: dict[str, int] | None = None):
        super().__init__()
        self.added = {token: np.array([n], "<u4").tobytes() for token, n in (added or {}).items()}
        # The leftmost token counts, of several at one place the longest.
        self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))).join("()"))
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(path, "rb"))}
        self.ranks, self.bpe = ranks, self.merges(ranks, public_tokenizers.PATTERN)
        self.words, self.wide, self.room = re.compile(NARROW).findall, re.compile("[^\x00-\u024f]").search, room
        self.long_run = re.compile(rf"\s{{{LONG_RUN}}}").search

    @staticmethod
    def merges(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        found = np.array(self.bpe.encode_ordinary(word), "<u4").tobytes()
        if len(word) <= REMEMBERED:
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if not any(token in text for token in self.added):
            return self.plain(text)
        parts = self.marks.split(text)
        return b"".join(self.added[part] if i % 2 else self.plain(part) for i, part in enumerate(parts))

    def plain(self, text: str) -> bytes:
        if len(text) >= LONG_RUN and self.long_run(text):
            whole = self.merges(self.ranks, r"[\s\S]+")
            words = regex.findall(public_tokenizers.PATTERN, text)
            return b"".join(np.array(whole.encode_ordinary(word), "<u4").tobytes() for word in words)
        if self.wide(text):
            return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()
        if len(self) > self.room:
            self.clear()
        return b"".join(map(self.__getitem__, self.words(text)))


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: one, or full ones behind a first that may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, id: str, text: str, capacity: int, path: str) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of all documents. A null text counts as empty and has the end id alone."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(path, added=added_tokens(path))
        for batch in batches:
            rows = []
            for key, value in zip(batch["id"].to_numpy(dtype=object, na_value=None), batch["text"]):
                ids = encoder.encode(value or "") + end
                for i, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    rows.append((key, i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id]
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long"
    )


@dataclass(frozen=True)
class Bin:
    """``copies`` sequences with documents of these lengths."""

    lengths: tuple[int, ...]
    copies: int


def _tighter_pair(left: np.ndarray, smallest: int, gap: int) -> tuple[int, int] | None:
    """Two lengths still unpacked that together exceed ``smallest`` and fit ``gap``, as tightly as can be."""
    lengths = np.flatnonzero(left[:gap]).tolist()
    i, j, most, best = 0, len(lengths) - 1, smallest, None
    while i <= j:
        a, b = lengths[i], lengths[j]
        if a + b > gap or (i == j and left[a] < 2):
            j -= 1
            continue
        if a + b > most:
            most, best = a + b, (b, a)
            if most == gap:
                break
        i += 1
    return best


def exchanged(counts: np.ndarray) -> list[Bin]:
    """Bins that are each filled greedily and then tightened by exchanges, until nothing is left.

    Equal bins are made at once, as many as the counts allow; a length runs out with each step or nearly so, so there
    are few kinds of bins however many documents there are.
    """
    left, capacity, bins = counts.astype(np.int64).copy(), len(counts) - 1, []
    present = np.flatnonzero(left).tolist()
    while present:
        before, gap, chosen = left.copy(), capacity, []
        at = len(present)
        while at:
            at = min(at, bisect_right(present, gap))
            if not at:
                break
            n = present[at - 1]
            take = min(int(left[n]), gap // n)
            chosen += [n] * take
            left[n] -= take
            gap -= n * take
            at -= 1
        while gap:
            smallest = chosen[-1]
            pair = _tighter_pair(left, smallest, gap + smallest)
            if pair is None:
                break
            left[smallest] += 1
            for n in pair:
                left[n] -= 1
            chosen = sorted([*chosen[:-1], *pair], reverse=True)
            gap += smallest - sum(pair)
        used = before - left
        kinds = np.flatnonzero(used)
        copies = int((before[kinds] // used[kinds]).min())
        left = before - copies * used
        bins.append(Bin(tuple(chosen), copies))
        present = np.flatnonzero(left).tolist()
    return bins


def best_fit(counts: np.ndarray) -> list[Bin]:
    """Best-fit decreasing: each length, longest first, goes to the bins with the smallest gaps that hold it."""
    capacity, open_bins = len(counts) - 1, defaultdict(list)  # by gap
    for n in np.flatnonzero(counts)[::-1].tolist():
        rest = int(counts[n])
        for gap in sorted(g for g in open_bins if g >= n):
            # A bin that has taken one is the tightest for the next, as long as it has room.
            each, kinds = gap // n, open_bins.pop(gap)
            while kinds and rest:
                b = kinds.pop()
                full = min(b.copies, rest // each)
                some = rest % each if full < b.copies and full == rest // each else 0
                for copies, take in ((full, each), (1 if some else 0, some)):
                    if copies:
                        open_bins[gap - take * n].append(Bin((*b.lengths, *[n] * take), copies))
                rest -= full * each + some
                untouched = b.copies - full - (some > 0)
                if untouched:
                    kinds.append(Bin(b.lengths, untouched))
            if kinds:
                open_bins[gap] += kinds
            if not rest:
                break
        each = capacity // n
        for copies, take in ((rest // each, each), (1 if rest % each else 0, rest % each)):
            if copies:
                open_bins[capacity - take * n].append(Bin((n,) * take, copies))
    return [b for kinds in open_bins.values() for b in kinds]


def best_two_fit(counts: np.ndarray) -> list[Bin]:
    """Bins for ``counts[n]`` documents of each length n; the capacity is the largest index.

    The kinds of bins that exchanges make, with the last 0, 1, 2, 4, ... or all kinds packed again by :func:`best_fit`,
    whichever takes the fewest bins; the fewest kinds packed again of several. So there are never more than best-fit
    decreasing needs.
    """
    def size(plan: list[Bin]) -> int:
        return sum(b.copies for b in plan)

    bins, left, best = exchanged(counts), np.zeros(len(counts), np.int64), None
    least = -(-int(counts @ np.arange(len(counts))) // (len(counts) - 1))
    at, last = len(bins), 0
    while best is None or size(best) > least and at:
        keep = max(0, len(bins) - last)
        for b in bins[keep:at]:
            np.add.at(left, list(b.lengths), b.copies)
        at, last = keep, 2 * last or 1
        plan = bins[:keep] + best_fit(left)
        if best is None or size(plan) < size(best):
            best = plan
    return best


def slots(bins: list[Bin]) -> pd.DataFrame:
    """(length, first, sequence, at): pieces of a length from rank ``first`` on go to the sequences from ``sequence``
    on, one each, at the offset ``at``."""
    ranks, rows, sequence = {}, [], 0
    for b in bins:
        at = 0
        for n in b.lengths:
            rows.append((n, ranks.get(n, 0), sequence, at))
            ranks[n] = ranks.get(n, 0) + b.copies
            at += n
        sequence += b.copies
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "at"]).astype("int64").sort_values(["length", "first"])


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Every row of ``docs`` is packed, also repeated ones, null ids and null or empty texts (the end id alone). The driver
    gets one count for each length. Ranks are counted by length and part of the pieces, so that a frequent length is
    spread over as many tasks as there are shuffle partitions. An empty table gives no rows.
    """
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    parts = shuffle_partitions(docs.sparkSession)
    cut = pieces(docs, id, text, capacity, path).withColumn("row", F.monotonically_increasing_id())
    cut = materialize(cut.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")), "pieces")
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    plan = slots(best_two_fit(histogram))
    # length and rank as one number, whose order is that of the pair
    edges = (plan["length"].to_numpy() << 50) + plan["first"].to_numpy()
    first, sequence, at = (plan[c].to_numpy() for c in ("first", "sequence", "at"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rank = batch["rank"].to_numpy()
            i = np.searchsorted(edges, (batch["length"].to_numpy() << 50) + rank, side="right") - 1
            batch["sequence_id"], batch["offset"] = sequence[i] + rank - first[i], at[i]
            yield batch.drop(columns="rank")

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "part").orderBy("row"))
    ranked = cut.withColumn("inside", inside).join(starts, ["length", "part"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("inside") - 1).alias("rank")
    )
    kind = dict(docs.dtypes)[id]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked.mapInPandas(place, schema).withColumnRenamed("id", id)
