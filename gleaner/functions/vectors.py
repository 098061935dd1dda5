"""Column functions over arrays of doubles. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-10


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column, floor: float = TINY) -> Column:
    """a . b / max(|a| |b|, floor)."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(floor))


def relevance(query: Column, v: Column) -> Column:
    """Cosine cut to 0..1; a zero vector is irrelevant."""
    return F.least(F.greatest(cosine(query, v), F.lit(0.0)), F.lit(1.0))


def unit(v: Column) -> Column:
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x / n)


def fitted(v: Column, n: int) -> Column:
    """The first n components, zeros after the last."""
    return F.concat(F.slice(v, 1, n), F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(v), F.lit(0))))


def literal(values) -> Column:
    """An array of doubles known to the driver, such as a query vector."""
    return F.array(*[F.lit(float(x)) for x in values])


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
