"""Vector codes against the plain comparison with every entry."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import codes


def plain(rows, parts, entries, rounds):
    """(codes and errors by row, codebooks) of integer vectors in id order, by comparing everything."""
    x = np.array(rows, dtype=object).reshape(len(rows), parts, -1)
    books = np.array([x[:entries, p] for p in range(parts)], dtype=object)

    def assign():
        return np.array([[min((int(((v - e) ** 2).sum()), i) for i, e in enumerate(books[p])) for p, v in enumerate(row)] for row in x], dtype=object)

    for _ in range(rounds):
        nearest = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, near in zip(x, nearest) if near[p][1] == e]
                if mine:
                    books[p][e] = [sum(column) // len(mine) for column in zip(*mine)]
    nearest = assign()
    return nearest[:, :, 1], nearest[:, :, 0].sum(axis=1), books


def integers(vector):
    return [int(np.floor(256 * x)) for x in vector]


@pytest.mark.parametrize("kind, depth", [("random", None), ("clustered", 3), ("clustered", 1), ("equal", None), ("large", 2)])
def test_codes_are_those_of_the_plain_comparison(spark, kind, depth):
    rng = np.random.default_rng(7)
    data = {
        "random": lambda: rng.normal(size=(300, 8)),
        "clustered": lambda: rng.normal(size=(12, 8))[rng.integers(0, 12, 300)] + rng.normal(size=(300, 8)) / 50,
        "equal": lambda: np.full((40, 8), 0.25),
        "large": lambda: rng.normal(size=(120, 8)) * 1e4,
    }[kind]()
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(data)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    found = codes.compress(frame, parts=4, entries=16, rounds=3, depth=depth)
    code, error, books = plain([integers(v) for _, v, _ in rows], 4, 16, 3)
    assert found.books.tolist() == books.tolist()
    for row in found.rows.collect():
        assert list(row["code"]) == list(code[row["vec_id"]]) and row["error"] == error[row["vec_id"]] and row["label"] == row["vec_id"] % 3
    assert found.rows.count() == len(rows)
    assert found.digest() == hashlib.sha256(",".join(str(c) for c in books.reshape(-1)).encode()).hexdigest()
    if kind == "clustered":
        assert found.work[-1][0] > 0.5 * sum(found.work[-1])  # most parts need no comparison


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(2, [0.5, 1.0, -0.25, 0.0]), (1, [0.5, 1.0, -0.25, 0.001]), (1, [0.25, 1.0, -0.25, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (7, [1e30, -1e300, 5e-324, -5e-324])]
    bad = [(3, None), (4, [nan, 0.0, 0.0, 0.0]), (5, [0.0, inf, 0.0, 0.0]), (6, [0.0, None, 0.0, 0.0])]
    other = [(0, []), (0, [1.0]), (8, [1.0, 2.0]), (9, [1.0] * 8)]
    frame = spark.createDataFrame(good + bad + other, "vec_id long, embedding array<double>").select(
        "*", F.lit(1).alias("code"), F.lit(2).alias("error"), F.lit(3).alias("grid"), F.lit("x").alias("kept"), F.lit(None).cast("int").alias("part"), F.lit(5).alias("label")
    )
    found = codes.compress(frame, parts=4, entries=3, rounds=2)
    rows = found.rows.collect()
    assert sorted(str(r["vec_id"]) for r in rows) == sorted(str(i) for i, _ in good + other)
    assert all((r["code"] is None) == (r["error"] is None) == (r["vec_id"] in (0, 8, 9)) for r in rows)
    assert found.books.shape == (4, 3, 1)
    kept = codes.compress(frame, parts=4, entries=3, rounds=2, keep=("code", "part")).rows
    assert kept.columns[:3] == ["vec_id", "code", "part"] or len(kept.columns) == 5
    nothing = codes.compress(frame.where("false"))
    assert nothing.rows.count() == 0 and nothing.rows.columns == ["vec_id", "label", "code", "error"]
    assert codes.compress(frame.where("vec_id = 8")).rows.first()["code"] is None


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(1)
    frame = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(rng.normal(size=(200, 4)))], "vec_id long, embedding array<double>, label int")
    found = codes.compress(frame, parts=4, entries=64, rounds=2)
    both = found.rows.withColumn("back", found.decode(F.col("code"))).join(frame, "vec_id").collect()
    assert max(abs(a - b) for r in both for a, b in zip(r["back"], r["embedding"])) < 0.6
    for r in both:
        exact = sum((np.floor(256 * a) - np.floor(256 * b)) ** 2 for a, b in zip(r["back"], r["embedding"]))
        assert exact == r["error"]


def test_a_lost_list_never_hides_the_nearest_entry():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.integers(-40, 40, size=(60, 2, 3))
        books = rng.integers(-40, 40, size=(2, 12, 3))
        depth = int(rng.integers(1, 12))
        batch = codes.Batch.fresh(x, books, depth)
        for _ in range(4):
            new = books + rng.integers(-6, 7, size=books.shape)
            moves = codes.root_ceil(((new - books) ** 2).sum(2))
            near, low = codes.unpack(batch.pack(), 2, batch.near.shape[2])
            batch, needs, scans = codes.again(x, batch.code, near, low, new, moves)
            books = new
            for p in range(2):
                d = codes.squares(x[:, p], books[p])
                assert (batch.code[:, p] == d.argmin(1)).all() and (batch.error[:, p] == d.min(1)).all()
            then = codes.next_depth(batch.near.shape[2], 12, needs, scans)
            if then < batch.near.shape[2]:
                batch = codes.shallower(batch, then)
