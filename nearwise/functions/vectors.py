"""Vector expressions over ``array<float>`` columns; arithmetic is done in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(vector: Column | str) -> Column:
    """The vector with double elements."""
    return _col(vector).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product."""
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance."""
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column | str) -> Column:
    """Euclidean length."""
    squares = F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null when either vector has length zero."""
    return F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))


def unit(vector: Column | str) -> Column:
    """The vector scaled to length one; null for a zero vector.

    The norm is bound once through a one-element array, so it is not recomputed for every element.
    """
    scaled = F.transform(
        F.array(l2_norm(vector)),
        lambda norm: F.when(norm > 0, F.transform(as_double(vector), lambda x: x / norm)),
    )
    return F.get(scaled, F.lit(0))


def scale(vector: Column | str, factor: Column) -> Column:
    """The vector times a number, in double."""
    return F.transform(as_double(vector), lambda x: x * factor)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
