"""Bigram language model by deleted interpolation.

p(w | u) = a * c(u, w) / c(u) + b * c(w) / N + c / (V + 1), with weights a, b, c for each bucket of the context's
frequency c(u). They are learned by expectation-maximisation on deleted counts: each training bigram is judged by
the counts without it. For learning alone, estimates are rounded to half powers of two, which bounds the histogram that
the weights are learned from.

Documents are encoded once, in chunks of about CHUNK tokens. A chunk sends the hashes of its distinct tokens and
bigrams, with its own counts, to the tasks that own them, packed by range of hash; they answer with the counts of the
whole corpus. So a shuffle carries one entry for each distinct bigram of a chunk, not for each token, and no table of
counts is broadcast or collected. Tokens are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.tables import LOWER, shuffle_partitions
from lodestone.session import materialize

CHUNK = 1_000_000
RANGE = 4_000_000  # tokens of the corpus for each range of hashes: what a task holds at once, at most
# Hashed like words, which hold no white space: the end of a text, and the context of its first token.
END, START = b" ", b"\t"
BUCKETS = 48  # of a context's frequency: 0, 1, 2-3, 4-7, ...
GRID = 96  # steps of half a power of two in the histogram that the weights are learned from
ROUNDS = 200
FLOOR = 1e-4  # least weight of the uniform part, so that no probability is zero


def pack(values: np.ndarray) -> bytes:
    """An integer array as compressed bytes, byte by byte of significance."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def bigram_keys(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    mixed = before * np.uint64(0x9E3779B97F4A7C15) ^ (after + (before >> np.uint64(7)))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(29))


class Vocabulary(dict):
    """Numbers tokens in the order in which they come."""

    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def encode(docs: DataFrame, id: str, text: str, held_out: str) -> DataFrame:
    """Chunks of whole documents: ids, held_out flags, token counts, hashes of the vocabulary, token numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, held, lengths, parts, size = [], [], [], [], 0
        words = Vocabulary({END: 0, START: 1})

        def chunk() -> pd.DataFrame:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            tokens = np.concatenate(parts)
            # Numbers by falling frequency make small bytes.
            order = np.r_[0, 1, 2 + np.argsort(-np.bincount(tokens, minlength=len(words))[2:], kind="stable")]
            place = np.empty(len(words), np.int32)
            place[order] = np.arange(len(words), dtype=np.int32)
            return pd.DataFrame({"ids": [ids], "held": [held], "lengths": [lengths], "vocabulary": [hashes[order].tobytes()], "tokens": [pack(place[tokens])]})

        for batch in batches:
            for key, value, out in zip(batch["id"].to_numpy(dtype=object, na_value=None), batch["text"], batch["held"]):
                split = (value or "").encode("utf-8", "replace").translate(LOWER).split()
                split.append(END)
                ids.append(key)
                held.append(bool(out))
                lengths.append(len(split))
                parts.append(np.fromiter(map(words.__getitem__, split), np.int32, len(split)))
                size += len(split)
                if size >= CHUNK:
                    yield chunk()
                    ids, held, lengths, parts, size = [], [], [], [], 0
                    words = Vocabulary({END: 0, START: 1})
        if ids:
            yield chunk()

    kind = dict(docs.dtypes)[id]
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.col(held_out).alias("held"))
    return slim.mapInPandas(run, f"ids array<{kind}>, held array<boolean>, lengths array<int>, vocabulary binary, tokens binary")


class Chunk:
    """A chunk's tokens and bigrams, with its own training counts, sorted by hash."""

    def __init__(self, row):
        self.lengths = np.asarray(row["lengths"], np.int64)
        self.held = np.asarray(row["held"], bool)
        self.vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
        self.tokens = unpack(row["tokens"], np.int32)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = 1  # START
        self.train = np.repeat(~self.held, self.lengths)

    def counts(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(hashes, training counts, place of each token) for tokens and for bigrams."""
        order = np.argsort(self.vocabulary, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        single = np.bincount(place[self.tokens], self.train, len(order)).astype(np.uint32)
        pairs = bigram_keys(self.vocabulary[self.before], self.vocabulary[self.tokens])
        keys, inverse = np.unique(pairs, return_inverse=True)
        double = np.bincount(inverse, self.train, len(keys)).astype(np.uint32)
        return [(self.vocabulary[order], single, place[self.tokens]), (keys, double, inverse)]


def ranges(tokens: int, least: int) -> int:
    """Leading bits of a hash that name its range: at least as many ranges as ``least``, and one for RANGE tokens."""
    return max(1, (max(least, -(-tokens // RANGE)) - 1).bit_length())


def questions(chunks: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, keys and counts of tokens and of bigrams): what each chunk has in each range of hashes."""
    shift = np.uint64(64 - bits)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                columns, parts = {}, Chunk(row).counts()
                used = np.unique(np.concatenate([keys >> shift for keys, _, _ in parts]))
                edges = used << shift
                columns["bucket"] = used.astype(np.int32)
                for name, (keys, n, _) in zip(("token", "bigram"), parts):
                    cut = np.r_[np.searchsorted(keys, edges), len(keys)]
                    spans = list(zip(cut, cut[1:]))
                    columns[f"{name}_keys"] = [pack(np.diff(keys[a:b], prepend=edges[i : i + 1])) for i, (a, b) in enumerate(spans)]
                    columns[f"{name}_counts"] = [pack(n[a:b]) for a, b in spans]
                out = pd.DataFrame(columns)
                out.insert(0, "chunk", row["chunk"])
                yield out

    return chunks.select("chunk", "held", "lengths", "vocabulary", "tokens").mapInPandas(
        run, "chunk long, bucket int, token_keys binary, token_counts binary, bigram_keys binary, bigram_counts binary"
    )


def answers(asked: DataFrame, bits: int) -> DataFrame:
    """The same (chunk, bucket) with the counts over all chunks; one row a bucket also says how many tokens (n) and
    distinct tokens (v) of training it owns."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        edge = np.uint64(int(group["bucket"].iloc[0]) << (64 - bits))
        out = group[["chunk", "bucket"]].copy()
        for name in ("token", "bigram"):
            keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) + edge for k in group[f"{name}_keys"]]
            every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate([unpack(n, np.uint32) for n in group[f"{name}_counts"]])
            total = np.bincount(inverse, counts, len(every)).astype(np.int64)
            answer, ends = total[inverse], np.cumsum([len(k) for k in keys])
            out[f"{name}_counts"] = [pack(part) for part in np.split(answer, ends[:-1])]
            if name == "token":
                out["n"], out["v"] = 0, 0
                out.iloc[0, out.columns.get_indexer(["n", "v"])] = total.sum(), np.count_nonzero(total)
        return out

    return asked.groupBy("bucket").applyInPandas(
        run, "chunk long, bucket int, token_counts binary, bigram_counts binary, n long, v long"
    )


def frequency_bucket(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(float))[1], BUCKETS - 1)


def _steps(ratio: np.ndarray) -> np.ndarray:
    """0 for a ratio of 0, else its half powers of two, kept inside the grid."""
    with np.errstate(divide="ignore"):
        steps = np.rint(2 * np.log2(ratio)) + GRID // 3
    return np.where(ratio > 0, np.clip(steps, 1, GRID - 1), 0).astype(np.int64)


def _ratio(steps: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, 2.0 ** ((steps - GRID // 3) / 2), 0.0)


def counted(chunks: DataFrame, answered: DataFrame, n: int, v: int) -> DataFrame:
    """Chunks with the corpus counts of each token's bigram and of the vocabulary, and a histogram of what the training
    tokens look like when deleted: bucket of the context, and both estimates relative to the uniform one."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0].to_dict()
        c, right = Chunk(row), right.sort_values("bucket")
        singles, pairs = (np.concatenate([unpack(x, np.int64) for x in right[f"{name}_counts"]]) for name in ("token", "bigram"))
        (hashes, _, _), (_, _, pair) = c.counts()
        single = singles[np.searchsorted(hashes, c.vocabulary)]
        context = contexts(c, single)[c.train]
        token, double = single[c.tokens][c.train], pairs[pair][c.train]
        b = frequency_bucket(context - 1)
        bigram = _steps((double - 1) / np.maximum(context - 1, 1) * (v + 1))
        unigram = _steps((token - 1) / max(n - 1, 1) * (v + 1))
        cells, weight = np.unique((b * GRID + bigram) * GRID + unigram, return_counts=True)
        return pd.DataFrame({
            "ids": [row["ids"]], "held": [row["held"]], "lengths": [row["lengths"]], "vocabulary": [row["vocabulary"]],
            "tokens": [row["tokens"]], "single": [pack(single)], "double": [pack(pairs[pair])],
            "cells": [cells], "weight": [weight],
        })

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chunks.schema if f.name != "chunk")
    return chunks.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(
        run, schema + ", single binary, double binary, cells array<long>, weight array<long>"
    )


def contexts(c: Chunk, single: np.ndarray) -> np.ndarray:
    """How often each token's context occurs in training; the start occurs as often as the end."""
    by_word = single.copy()
    by_word[1] = single[0]
    return by_word[c.before]


def learn(cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) for each bucket, by expectation-maximisation on a histogram."""
    if not len(cells):
        return np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))  # nothing to learn from
    b, rest = np.divmod(cells, GRID * GRID)
    parts = np.stack([_ratio(rest // GRID), _ratio(rest % GRID), np.ones(len(cells))], axis=1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # a context without a count has no bigrams
    seen = np.bincount(b, weight, BUCKETS) > 0
    for _ in range(ROUNDS):
        share = weights[b] * parts
        share *= (weight / share.sum(axis=1))[:, None]
        sums = np.stack([np.bincount(b, share[:, k], BUCKETS) for k in range(3)], axis=1)
        sums[:, 2] = np.maximum(sums[:, 2], FLOOR * sums.sum(axis=1))
        weights = np.where(seen[:, None], sums / np.maximum(sums.sum(axis=1), 1e-300)[:, None], weights)
    # Buckets that training has not seen do as the next lower one that it has.
    for k in range(1, BUCKETS):
        if not seen[k] and seen[:k].any():
            weights[k] = weights[k - 1] if k > 1 or seen[0] else weights[k]
    return weights


def score(chunks: DataFrame, weights: np.ndarray, n: int, v: int, id: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                c = Chunk(row)
                single, double = unpack(row["single"], np.int64), unpack(row["double"], np.int64)
                token, context = single[c.tokens], contexts(c, single)
                mix = weights[frequency_bucket(context)]
                chance = mix[:, 0] * double / np.maximum(context, 1) + mix[:, 1] * token / max(n, 1) + mix[:, 2] / (v + 1)
                base = np.log10((token + 1) / (n + v + 1))
                add = lambda x: np.add.reduceat(x, c.starts)
                yield pd.DataFrame({
                    "id": np.asarray(row["ids"], dtype=object), "held_out": c.held, "n_tokens": c.lengths,
                    "n_known": add((token > 0).astype(np.int64)), "train_tokens": n, "base_score": add(base), "score": add(np.log10(chance)),
                })

    kind = chunks.schema["ids"].dataType.elementType.simpleString()
    out = chunks.select("ids", "held", "lengths", "vocabulary", "tokens", "single", "double").mapInPandas(
        run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    return out.withColumnRenamed("id", id)


def score_documents(docs: DataFrame, held_out, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model learns from all rows for which the boolean column ``held_out`` is false (null counts as false). Null and
    blank texts have the end token alone. Without training rows every token is unknown. An empty table gives no rows.
    The driver gets three totals and a histogram whose size the constants above bound. Hashes are dealt to as many ranges
    as the counted tokens ask for, so that what a task holds at once does not grow with the corpus.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    chunks = materialize(encode(slim, "id", "text", "held").withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    size = chunks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    bits = ranges(size, shuffle_partitions(spark))
    answered = materialize(answers(questions(chunks, bits), bits), "counts")
    total = answered.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = total["n"] or 0, total["v"] or 0
    known = materialize(counted(chunks, answered.drop("n", "v"), n, v), "counted")
    pairs = known.select(F.explode(F.arrays_zip("cells", "weight")).alias("x")).groupBy("x.cells").agg(F.sum("x.weight").alias("w")).toPandas()
    weights = learn(pairs["cells"].to_numpy(np.int64), pairs["w"].to_numpy(np.float64))
    return score(known, weights, n, v, id)
