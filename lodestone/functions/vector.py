"""Column functions on ``array<float>`` embeddings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Similarity, 0 with an all-zero vector; for unit vectors it is the dot product and distance is ``1 - cosine``."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.when(lengths.isNotNull(), F.lit(0.0)))


def l2_normalize(a: Column) -> Column:
    """Unit-length copy; an all-zero vector is left as it is."""
    length = norm(a)
    safe = F.when(length > 0, length).otherwise(F.lit(1.0))
    return F.transform(a, lambda x: (x.cast("double") / safe).cast("float"))
