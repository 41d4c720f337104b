"""Dense vectors as arrays of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import unit


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def magnitude(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid(a: Column, dimensions: int | None = None) -> Column:
    """Of the right size, finite throughout and not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    size = (F.size(a) == dimensions) if dimensions else (F.size(a) > 0)
    return a.isNotNull() & size & F.forall(a, finite) & F.exists(a, lambda x: x != 0)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    norms = magnitude(a) * magnitude(b)
    return F.when(norms > 0, dot(a, b) / norms)


def cosine_clamped(a: Column, b: Column) -> Column:
    """In [0, 1]; 0 for vectors that aren't valid or differ in size."""
    return F.when(valid(a) & valid(b) & (F.size(a) == F.size(b)), unit(cosine(a, b))).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def scaled(a: Column, by: Column | float) -> Column:
    return F.transform(a, lambda x: x * by)


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    m = magnitude(a)
    return F.when(m > 0, scaled(a, 1 / m)).otherwise(a)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clamped(a: Column, low: float, high: float) -> Column:
    return F.transform(a, lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def lerp(a: Column, b: Column, t: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def blended(own: Column, neighbours: Column, weight: float = 0.6) -> Column:
    """weight of itself and the rest of its neighbours' mean, at unit length."""
    return normalised(plus(scaled(own, weight), scaled(neighbours, 1 - weight)))


def softmax(xs: Column) -> Column:
    top = F.array_max(xs)
    return F.transform(F.array(F.transform(xs, lambda x: F.exp(x - top))), lambda es: F.transform(es, lambda e: e / total(es)))[0]


def from_text(text: Column) -> Column:
    """'[1,2,3]' as a vector; null if it isn't one."""
    return F.from_json(text, "array<double>")


def to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
