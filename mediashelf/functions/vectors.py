"""Vector columns (array<float>), computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product: the cosine similarity of unit vectors."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    length = F.when(norm(v) > 0, norm(v)).otherwise(F.lit(1.0))
    # zip with a repeated length: inside a per-element lambda it would be recomputed for every element
    return F.zip_with(v, F.array_repeat(length, F.size(v)), lambda x, n: x.cast("double") / n)


def margin(query: Column, image: Column, baseline: Column) -> Column:
    """How much closer an image is to the query than to a content-free caption."""
    return dot(query, image) - dot(baseline, image)


def match_prob(cos: Column, scale: float, bias: float | None = None) -> Column:
    """Calibrated match probability; without a bias, the squashed cosine of softmax-trained models."""
    if bias is None:
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (cos - 0.15) / 0.2))
    z = cos * scale + bias
    return F.when(z > -50, 1 / (1 + F.exp(-z))).otherwise(F.lit(0.0))


def scale_rating(c: Column) -> Column:
    """An external 0-10 rating as 0..1."""
    return F.least(F.lit(10), F.greatest(F.lit(0), c)) / F.lit(10.0)
