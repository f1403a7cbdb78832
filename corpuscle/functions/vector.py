"""Vector arithmetic on array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def squared_l2(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Null where either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
