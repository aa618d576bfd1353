"""Distances and transforms of vectors as Column expressions: they stay in the JVM.

Vectors are arrays of numbers. Sums fold from left to right in double precision, so results
don't depend on how rows are partitioned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def fold(v: Column) -> Column:
    """Sum of an array of doubles from left to right."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def inner_product(a: Column, b: Column) -> Column:
    return fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def squared_norm(v: Column) -> Column:
    return fold(F.transform(doubles(v), lambda x: x * x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a vector is zero."""
    norms = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(norms > 0, 1 - inner_product(a, b) / norms).otherwise(1.0)


def cosine_of_units(a: Column, b: Column) -> Column:
    """Squared distance of the unit vectors, 2 - 2 cos: twice ``cosine``."""
    return 2 * cosine(a, b)


def fast_l2(a: Column, b: Column) -> Column:
    """|a|^2 - 2 <a, b>: orders a's as the squared distance to b does."""
    return squared_norm(a) - 2 * inner_product(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(l2(a, b))


def hamming(a: Column, b: Column) -> Column:
    """Number of places with different values."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda d: d))


def jaccard(a: Column, b: Column) -> Column:
    """1 - |a & b| / |a | b| of the values as sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, 1 - F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "l2": l2,
    "inner_product": negative_inner_product,
    "cosine": cosine,
    "cosine_of_units": cosine_of_units,
    "fast_l2": fast_l2,
    "euclidean": euclidean,
    "hamming": hamming,
    "jaccard": jaccard,
}


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise ValueError(f"unknown metric {name!r}; known: {', '.join(METRICS)}")
    return METRICS[name]


def register_metric(name: str, distance: Callable[[Column, Column], Column]) -> None:
    """Add a distance of two vector columns under a name."""
    METRICS[name] = distance


def scaled(v: Column, factor: Column) -> Column:
    return F.transform(doubles(v), lambda x: x * factor)


def normalized(v: Column, epsilon: float = 0.0) -> Column:
    """v over its length; ``epsilon`` is added to the sum of squares. A zero vector stays."""
    n = F.sqrt(squared_norm(v) + epsilon)
    return F.transform(doubles(v), lambda x: F.when(n > 0, x / n).otherwise(x))


def normalized_to(v: Column, base: float) -> Column:
    """v at length ``base``; a vector shorter than 1e-6 gets equal components of that length."""
    n = F.sqrt(squared_norm(v))
    return F.transform(doubles(v), lambda x: F.when(n < 1e-6, base / F.sqrt(F.size(v))).otherwise(x / n * base))


def augmented(v: Column, largest_norm: Column) -> Column:
    """v over the largest norm, with the coordinate that makes its length one: inner products become distances."""
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - squared_norm(v) / (largest_norm * largest_norm)))
    return F.concat(F.transform(doubles(v), lambda x: x / largest_norm), F.array(rest))


def augmented_query(v: Column) -> Column:
    return F.concat(normalized(v), F.array(F.lit(0.0)))


def rounded(x: Column, digits: int) -> Column:
    """Halves away from zero of x times a power of ten, as SQL's round has it; what rounds to zero keeps its sign."""
    power = F.lit(10.0**digits)
    whole = F.round(x * power)
    return F.when(whole == 0, x * 0.0).when(F.isnan(x) | (F.abs(x * power) == float("inf")), x).otherwise(whole / power)


def part(v: Column, first: int, n: int) -> Column:
    """n components from the one numbered ``first``, from 0."""
    return F.slice(v, first + 1, n)


def mean(v: Column) -> Column:
    return fold(doubles(v)) / F.size(v)


def deviation(v: Column) -> Column:
    """Population standard deviation of the components."""
    m = mean(v)
    return F.sqrt(fold(F.transform(doubles(v), lambda x: (x - m) * (x - m))) / F.size(v))


def matrix_times(rows: list[list[float]], v: Column) -> Column:
    """A constant matrix times v."""
    return F.array(*(fold(F.zip_with(doubles(v), F.array(*(F.lit(float(x)) for x in row)), lambda x, y: x * y)) for row in rows))
