"""Hard negatives against the plain comparison of all rows, and the index against its bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import negatives


def brute(rows, positives=5, count=10, low=30, high=90):
    good = [(i, l, [int(np.floor(256 * x)) for x in v]) for i, l, v in rows if l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (a, label, vector) in enumerate(good):
        if a is None or a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(vector, v)), last(i), i, l) for m, (i, l, v) in enumerate(good) if m != n and len(v) == len(vector)]
        scores.sort(key=lambda s: s[:2])
        for s, _, p, _ in [s for s in scores if s[3] == label][:positives]:
            window = [(i, -t) for t, _, i, l in scores if l != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, r + 1, i, -s, t) for r, (i, t) in enumerate(window[:count])]
    return sorted(out, key=str)


def mined(frame, **kind):
    return sorted(map(tuple, negatives.mine(frame, F.col("vec_id") % 100 == 0, F.col("label"), **kind).collect()), key=str)


@pytest.mark.parametrize("kind, block", [("random", 1 << 16), ("random", 70), ("clustered", 1 << 16), ("equal", 50), ("large", 64)])
def test_negatives_are_those_of_the_plain_comparison(spark, kind, block):
    rng = np.random.default_rng(5)
    data = {
        "random": lambda: rng.normal(size=(600, 6)) / 2,
        "clustered": lambda: rng.normal(size=(9, 6))[rng.integers(0, 9, 600)] + rng.normal(size=(600, 6)) / 30,
        "equal": lambda: np.repeat(rng.normal(size=(4, 6)), 60, axis=0),
        "large": lambda: rng.normal(size=(300, 6)) * 1e4,
    }[kind]()
    rows = [(10 * i, int(rng.integers(0, 4)), [float(x) for x in v]) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)
    found = mined(frame, block=block)
    assert found == brute(rows) and (found or kind == "equal")


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(6)
    rows = [(i, i % 2, [float(x) for x in np.abs(rng.normal(size=4))]) for i in range(0, 400, 10)]
    rows += [(100, 0, rows[0][2]), (100, 0, rows[0][2]), (100, 1, rows[1][2]), (None, 0, rows[2][2]), (None, 1, rows[3][2])]
    rows += [(500, None, [1.0] * 4), (600, 0, None), (700, 0, [nan, 1.0, 1.0, 1.0]), (800, 0, [1.0, None, 1.0, 1.0]), (900, 1, [1.0, 1.0, inf, 1.0])]
    rows += [(1000, 0, []), (1001, 0, []), (1002, 1, []), (1100, 1, [0.5]), (1101, 1, [2.0]), (1102, 0, [0.25]), (1200, 7, [1.0] * 4), (1300, 0, [0.0] * 4)]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").select(
        "*", F.lit(1).alias("row"), F.lit(2).alias("id"), F.lit(3).alias("dim"), F.lit(4).alias("rank"), F.lit(5).alias("bar")
    )
    found = mined(frame)
    assert found == brute(rows)
    assert any(r[3] is None for r in found) and any(r[0] == 1000 for r in found)
    assert mined(frame.where("false")) == [] and mined(frame.where("vec_id = 100 and label = 1")) == []


def test_few_cells_are_scored_where_rows_lie_in_clusters():
    rng = np.random.default_rng(8)
    centres = rng.integers(-200, 200, size=(32, 16))
    vectors = (centres[rng.integers(0, 32, 4000)] + rng.integers(-4, 5, size=(4000, 16))).astype(np.int32)
    label, row = rng.integers(0, 5, 4000), np.arange(4000)
    index = negatives.MultiIndex(row, row, label, vectors, 16)
    low, high = np.full((40, 1), 1 - negatives.MOST), np.full((40, 1), negatives.MOST)
    anchor, _, id, score, scored = negatives.best(index, row[:40], label[:40], vectors[:40], low, high, 5, True)
    assert len(anchor) == 200 and scored < 0.5 * 40 * 4000
    exact = vectors[:40].astype(np.int64) @ vectors.T.astype(np.int64)
    for a in range(40):
        others = [i for i in np.lexsort((row, -exact[a])) if label[i] == label[a] and i != a][:5]
        assert id[anchor == a].tolist() == others and score[anchor == a].tolist() == exact[a, others].tolist()


def test_cells_come_in_order_and_bounds_hold():
    rng = np.random.default_rng(9)
    first, second = rng.normal(size=7), rng.normal(size=5)
    sums = list(negatives.cells_by_bound(first, second))
    assert len({(i, j) for _, i, j in sums}) == 35 and all(a[0] >= b[0] for a, b in zip(sums, sums[1:]))
    vectors = rng.integers(-99, 99, size=(500, 9)).astype(np.int32)
    index = negatives.MultiIndex(np.arange(500), np.arange(500), np.zeros(500, int), vectors, 8)
    asking = rng.integers(-99, 99, size=(20, 9)).astype(np.float64)
    (up1, down1), (up2, down2) = index.bounds(asking)
    for cell, (start, end) in enumerate(zip(index.starts, index.starts[1:])):
        score = asking @ index.vectors[start:end].T
        a, b = divmod(cell, index.width)
        assert (score <= (up1[:, a] + up2[:, b])[:, None]).all() and (score >= (down1[:, a] + down2[:, b])[:, None]).all()
