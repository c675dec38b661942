"""Vector functions on arrays of numbers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; null if a vector is null, zero or of another length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms)


def cosine_to(a: Column, values: Sequence[float]) -> Column:
    """Cosine similarity to one vector, whose norm is computed once."""
    norm = math.sqrt(sum(float(v) ** 2 for v in values))
    own = F.sqrt(dot(a, a))
    return F.when((F.size(a) == len(values)) & (own > 0) & F.lit(norm > 0), dot(a, vector(values)) / (own * F.lit(norm or 1.0)))


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def recency_blend(similarity: Column, created: Column, as_of: Column, weight: float = 0.15, half_life_days: float = 90.0) -> Column:
    """Similarity mixed with an exponential decay by age; weight within 0 and 1, at least a day."""
    weight, span = min(1.0, max(0.0, weight)), max(1.0, half_life_days)
    age = F.greatest(F.lit(0.0), (F.unix_timestamp(as_of) - F.unix_timestamp(created)) / 86400.0)
    return similarity * (1 - weight) + F.exp(-age / span) * weight
