"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def inner(a: Column, b: Column) -> Column:
    """Plain inner product in double precision, without renormalising; null where either is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner(a, a))


def normalised(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(1e-8)))
