"""Language identification with blended-spectrum string kernels.

Two texts are as similar as the character n-grams of length 1 to 3 that both contain, each counted once whatever its
frequency: k(x, y) = |grams(x) & grams(y)|, divided by the root of k(x, x) k(y, y). N-grams are known by hashed
positions. Landmark texts give the Nyström map of this kernel; on it one ridge regression for each language separates
it from the rest. Batches of documents are scored by two matrix products: presence by landmarks, similarities by weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UNDETERMINED = "und"
# Hashed positions for n-grams of one, two and three characters.
SIZES = (1 << 10, 1 << 12, 1 << 14)
WIDTH = sum(SIZES)
SLICE = 1 << 20  # code points looked at together
BATCH = 128  # documents in one matrix product


def mark_grams(text: str, present: np.ndarray) -> None:
    """Set the positions of the n-grams of the lower-cased text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    for at in range(0, len(codes), SLICE):
        a = codes[at : at + SLICE + 2]
        mixed, first = a * np.uint32(0x9E3779B1), 0
        for n, size in enumerate(SIZES):
            if n:
                a = a[1:]
                mixed = (mixed[: len(a)] ^ (mixed[: len(a)] >> np.uint32(15))) * np.uint32(0x85EBCA77) + a * np.uint32(0xC2B2AE3D)
            present[first + (mixed >> np.uint32(33 - size.bit_length()))] = True
            first += size


def presence(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), bool)
    for row, text in zip(out, texts):
        mark_grams(text or "", row)
    return out


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised kernel of presence rows; a text without n-grams is similar to none."""
    common = x.astype(np.float32) @ y.T.astype(np.float32)
    return common / np.sqrt(np.maximum(np.outer(x.sum(axis=1), y.sum(axis=1)), 1))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    landmarks: np.ndarray  # packed presence rows
    weights: np.ndarray  # of the similarities to the landmarks, for each language
    offset: np.ndarray

    def predict(self, present: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share of the softmax of the margins, from presence rows and unpacked landmarks."""
        margins = kernel(present, marks) @ self.weights + self.offset
        odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
        best = margins.argmax(axis=1)
        return best, odds[np.arange(len(best)), best] / odds.sum(axis=1)


def fit(languages: np.ndarray, present: np.ndarray, per_language: int, ridge: float) -> Model:
    """``present``: a presence row for each sample. The first ``per_language`` of each language are landmarks."""
    names = sorted(set(languages))
    chosen = np.concatenate([np.flatnonzero(languages == name)[:per_language] for name in names])
    marks = present[chosen]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    strong = values > 1e-6 * values.max()
    nystrom = vectors[:, strong] / np.sqrt(values[strong])
    features = np.c_[kernel(present, marks) @ nystrom, np.ones(len(present))]
    targets = np.where(languages[:, None] == np.array(names)[None, :], 1.0, -1.0)
    penalty = np.full(features.shape[1], ridge)
    penalty[-1] = 0
    solved = np.linalg.solve(features.T @ features + np.diag(penalty) + 1e-9 * np.eye(len(penalty)), features.T @ targets)
    return Model(names, np.packbits(marks, axis=1), nystrom @ solved[:-1], solved[-1])


def train(
    docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = 400, landmarks: int = 16, ridge: float = 0.1,
) -> Model | None:
    """A model from about ``per_language`` labelled rows of each language for which ``training`` holds, whole texts,
    chosen by a hash of the id; None without any. The first ``landmarks`` of each language are landmarks.

    Rows with a null or empty text or label are left out. The sample's bound is the only one; predictions cover all rows.
    """
    slim = docs.where(training).select(F.col(lang).alias("lang"), F.xxhash64(F.col(id)).alias("h"), F.col(text).alias("text"))
    slim = slim.where("lang is not null and length(text) > 0")
    # Counts say which share of a language to take, so that no task sees all rows of one.
    counts = slim.groupBy("lang").count().collect()
    if not counts:
        return None
    inside = F.lit(False)
    for row in counts:
        share = min(1.0, per_language / row["count"])
        inside = inside | ((F.col("lang") == row["lang"]) & (F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [np.packbits(presence([t])[0]).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "h": batch["h"], "grams": rows})

    sample = slim.where(inside).mapInPandas(marked, "lang string, h long, grams binary")
    found = sample.groupBy("lang", "h").agg(F.min("grams").alias("grams")).toPandas().sort_values(["lang", "h"])
    if found.empty:
        return None
    present = np.unpackbits(np.stack([np.frombuffer(g, np.uint8) for g in found["grams"]]), axis=1, count=WIDTH).astype(bool)
    return fit(found["lang"].to_numpy(str), present, landmarks, ridge)


def predict(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its whole text alone. A null text or one without a letter is ``und``
    with score 0, and so is every text without a model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = model and np.unpackbits(model.landmarks, axis=1, count=WIDTH).astype(bool)
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                texts = part["text"].tolist()
                names, scores = np.full(len(part), UNDETERMINED, object), np.zeros(len(part))
                known = np.array([bool(model and t and any(map(str.isalpha, t))) for t in texts])
                if known.any():
                    best, share = model.predict(presence([t for t, k in zip(texts, known) if k]), marks)
                    names[known], scores[known] = np.array(model.languages, object)[best], share
                yield pd.DataFrame({"id": part["id"].to_numpy(dtype=object, na_value=None), "lang_pred": names, "score": scores})

    kind = dict(docs.dtypes)[id]
    slim = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return slim.mapInPandas(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)
