"""Arithmetic on vector columns, folded in array order in double precision."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Scores are compared and returned at this many decimals, so that neither summation order
# nor batch size can reorder equal items; among equals the smaller id is first.
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector has no direction and becomes NULL."""
    length = norm(v)
    return F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length))


def vector_dim(v: Column) -> Column:
    return F.size(v)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of the angle; NULL if either vector is NULL or zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths)


def score(a: Column, b: Column) -> Column:
    """Cosine similarity at the precision used for ranking."""
    return F.round(cosine_similarity(a, b), SCORE_DIGITS)
