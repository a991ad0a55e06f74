"""Overlapping text chunks with page provenance."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

# Chunk size and overlap in characters.
SIZE, OVERLAP = 900, 180
# A chunk may end after one of these.
BREAK = "[.;] "
# Fixed value: sentences end before the blanks that follow one of these marks.
SENTENCE_END = r"(?<=[.!?])\s+"


def windows(text: str, size: int, overlap: int) -> list[str]:
    """Pieces of at most ``size`` characters that end after a break in their second half if any."""
    text = text.strip()
    breaks = [m.start() for m in re.finditer(BREAK, text)]
    pieces, start = [], 0
    while start < len(text):
        end = start + size
        if end >= len(text):
            pieces.append(text[start:].strip())
            break
        at = bisect_right(breaks, end - 2) - 1
        if at >= 0 and breaks[at] > start + size // 2:
            end = breaks[at] + 1
        pieces.append(text[start:end].strip())
        start = max(end - overlap, start + 1)
    return pieces


def packs(text: str, size: int, overlap: int) -> list[str]:
    """Whole sentences packed up to ``size`` characters. Each pack repeats the last sentences of the one
    before as long as they fit into ``overlap``; a sentence is never split."""
    sentences = [s for s in (part.strip() for part in re.split(SENTENCE_END, text)) if s]
    # ends[j] - ends[i] - 1 is the length of sentences i..j-1 joined by blanks.
    ends = list(accumulate((len(s) + 1 for s in sentences), initial=0))
    bounds, first = [], 0
    for j in range(1, len(sentences)):
        if ends[j + 1] - ends[first] - 1 > size:
            bounds.append((first, j))
            first = max(first, bisect_left(ends, ends[j] - 1 - overlap, hi=j))
    if sentences:
        bounds.append((first, len(sentences)))
    return [" ".join(sentences[i:j]) for i, j in bounds]


# Steps of an inner fold, so that lists of pieces grow by whole slices.
SLICE = 256


def _bound(value: Column, use) -> Column:
    """``use(v)`` with ``value`` evaluated once, whatever number of times ``v`` occurs."""
    return F.transform(F.array(value), use)[0]


def _fold(steps: Column, start: Column, step) -> Column:
    """Fold ``step(state, i)`` over 0 .. steps - 1 in slices; a state is (..., pieces) and keeps the pieces of all slices."""
    state = "struct<at:bigint,open:array<string>,pieces:array<string>>"

    def outer(all_, k):
        fresh = F.struct(all_["at"].alias("at"), all_["open"].alias("open"), F.array().cast("array<string>").alias("pieces")).cast(state)
        last = F.least(steps, (k + 1) * SLICE) - 1
        return _bound(
            F.aggregate(F.sequence(k * SLICE, last), fresh, lambda now, i: step(now, i).cast(state)),
            lambda s: F.struct(s["at"].alias("at"), s["open"].alias("open"), F.concat(all_["pieces"], s["pieces"]).alias("pieces")).cast(state),
        )

    slices = F.sequence(F.lit(0), F.floor((steps - 1) / SLICE).cast("int"))
    return F.when(steps > 0, F.aggregate(slices, start.cast(state), outer))


def _state(at: Column, open_: Column, pieces: Column) -> Column:
    return F.struct(at.cast("long").alias("at"), open_.alias("open"), pieces.alias("pieces"))


def _none() -> Column:
    return F.array().cast("array<string>")


def _stripped(col: Column) -> Column:
    """Without blanks at either end, of all kinds that Python's ``strip`` knows."""
    return F.regexp_replace(F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+\z", "")


def sliding_pieces(col: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """What :func:`windows` gives, without Python. The text is cut into blocks of ``size`` characters first, so that a window
    is taken from two of them and not from the start of the text."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    half = size // 2
    least = max(1, half + 1 - overlap)  # every window starts at least so much later than the one before

    def pieces(v):
        def step(now, i):
            start = now["at"]
            block = F.floor(start / size).cast("int")
            pair = F.concat(F.get(v["blocks"], block), F.coalesce(F.get(v["blocks"], block + 1), F.lit("")))
            whole = F.substring(pair, (start % size + 1).cast("int"), F.lit(size))

            def placed(window):
                broken = F.regexp_extract(window, f"(?s)^(.{{{half + 1},}}[.;]) ", 1)
                taken = F.when((start + size < v["length"]) & (broken != ""), broken).otherwise(window)
                return _bound(
                    taken,
                    lambda t: _state(
                        F.when(start + size >= v["length"], v["length"]).otherwise(F.greatest(start + F.length(t) - overlap, start + 1)),
                        now["open"], F.concat(now["pieces"], F.array(_stripped(t))),
                    ),
                )

            return F.when(start < v["length"], _bound(whole, placed)).otherwise(now)

        steps = F.floor(v["length"] / least).cast("int") + F.when(v["length"] > 0, 1).otherwise(0)
        return F.coalesce(_fold(steps, _state(F.lit(0), _none(), _none()), step)["pieces"], _none())

    text = _bound(
        _stripped(col),
        lambda t: F.struct(F.length(t).cast("long").alias("length"), F.regexp_extract_all(t, F.lit(f"(?s).{{1,{size}}}"), 0).alias("blocks")),
    )
    return F.when(col.isNotNull(), _bound(text, pieces))


def sentence_pieces(col: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """What :func:`packs` gives, without Python: sentences are folded into packs, ``at`` being the open pack's length."""

    def pieces(found):
        def step(now, i):
            def add(sentence):
                joined = F.array_join(now["open"], " ")
                full = (F.size(now["open"]) > 0) & (now["at"] + 1 + F.length(sentence) > size)
                tail = lambda j: F.slice(now["open"], j, F.size(now["open"]))
                first = F.get(F.filter(F.sequence(F.lit(1), F.size(now["open"])), lambda j: F.length(F.array_join(tail(j), " ")) <= overlap), 0)
                kept = F.when(first.isNotNull(), tail(F.coalesce(first, F.lit(1)))).otherwise(_none())

                def opened(open_):
                    length = F.when(F.size(open_) == 1, F.length(sentence)).otherwise(F.length(F.array_join(open_, " ")))
                    return _state(length, open_, F.concat(now["pieces"], F.array(joined)))

                more = _state(
                    F.when(F.size(now["open"]) == 0, F.length(sentence)).otherwise(now["at"] + 1 + F.length(sentence)),
                    F.concat(now["open"], F.array(sentence)), now["pieces"],
                )
                return F.when(full, _bound(F.concat(kept, F.array(sentence)), opened)).otherwise(more)

            return _bound(F.get(found, i), add)

        end = _fold(F.size(found), _state(F.lit(0), _none(), _none()), step)
        last = lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["pieces"], F.array(F.array_join(s["open"], " ")))).otherwise(s["pieces"])
        return F.coalesce(_bound(end, last), _none())

    parts = F.transform(F.split(col, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"), _stripped)
    return F.when(col.isNotNull(), _bound(F.filter(parts, lambda s: s != ""), pieces))


def _numbered(pages: DataFrame, pieces: Column, size: int, overlap: int) -> DataFrame:
    number = F.col("_pos") + 1
    # The outer form: a plain explode adds a test for emptiness that would cut every page a second time.
    return pages.withColumn("_pieces", pieces).select(
        "document_id", "document_type", "source_file", "page_number", F.posexplode_outer("_pieces").alias("_pos", "text")
    ).filter("text IS NOT NULL").select(
        F.concat(
            F.col("document_id"), F.lit(":p"), F.col("page_number").cast("string"), F.lit(":c"), number.cast("string")
        ).alias("chunk_id"),
        "document_id", "document_type", "source_file", "page_number",
        number.alias("chunk_index"),
        F.lit(size).alias("chunk_size_characters"),
        F.lit(overlap).alias("overlap_characters"),
        "text",
    )


def sliding(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return _numbered(pages, sliding_pieces(F.col("text"), size, overlap), size, overlap)


def sentences(pages: DataFrame, size: int = SIZE, overlap: int = OVERLAP, indexed_at: str | None = None) -> DataFrame:
    out = _numbered(pages, sentence_pieces(F.col("text"), size, overlap), size, overlap)
    return out if indexed_at is None else out.withColumn("indexed_at", F.lit(indexed_at))
