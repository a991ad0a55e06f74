"""Chunkers without Python against the plain loops that they stand for."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunk

TEXTS = ["", "   ", "a", "One. Two; three", "x" * 901, "x" * 1800, "word. " * 700, "  Ünï 日本語。 é; " * 120, "😀. " * 900, "no break " * 500, "!" * 2000, "A! B? C. " * 400]


def random_texts():
    rng = random.Random(4)
    words = ["alpha", "beta.", "gamma;", "Δελτα", "é!", "x" * 40, "end?", "\n", "\t", "😀"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 900))) for _ in range(60)] + ["s" * 300 + ". " + "t" * 1200 + ". u."]


@pytest.mark.parametrize("size, overlap", [(900, 180), (50, 10), (40, 39), (7, 3)])
def test_pieces_are_those_of_the_loops(spark, size, overlap):
    texts = TEXTS + random_texts()
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, text string")
    rows = frame.select("i", chunk.sliding_pieces(F.col("text"), size, overlap).alias("w"), chunk.sentence_pieces(F.col("text"), size, overlap).alias("s")).collect()
    for row in rows:
        if row.i < 0:
            assert row.w is None and row.s is None
            continue
        assert row.w == chunk.windows(texts[row.i], size, overlap), (size, texts[row.i][:60])
        assert row.s == chunk.packs(texts[row.i], size, overlap), (size, texts[row.i][:60])


def test_no_python_worker_and_long_texts(spark):
    long = spark.range(1).select(F.repeat(F.lit("A sentence of some length, é. "), 40_000).alias("text"))
    out = long.select(chunk.sliding_pieces(F.col("text")).alias("w"), chunk.sentence_pieces(F.col("text")).alias("s"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    text = "A sentence of some length, é. " * 40_000
    row = out.first()
    assert row.w == chunk.windows(text, 900, 180) and row.s == chunk.packs(text, 900, 180)
