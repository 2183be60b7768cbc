"""Vector functions over ARRAY<FLOAT> or ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def same_length(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors differ in length")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0; an error if the lengths differ."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return same_length(a, b, F.when(norms == 0, F.lit(0.0)).otherwise(_dot(a, b) / norms))


def euclidean(a: Column, b: Column) -> Column:
    return same_length(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2))), F.lit(0.0), lambda s, x: s + x)))


def l2_normalise(a: Column) -> Column:
    norm = F.sqrt(_dot(a, a))
    return F.transform(a, lambda x: F.when(norm == 0, x.cast("double")).otherwise(x.cast("double") / norm))


def mean_pool(vectors: Column) -> Column:
    """Mean of an array of vectors of the same length."""
    total = F.aggregate(F.slice(vectors, 2, F.greatest(F.size(vectors), F.lit(1))), F.transform(F.get(vectors, F.lit(0)), lambda x: x.cast("double")), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: x / F.size(vectors))
