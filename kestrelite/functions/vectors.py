"""Vector columns: inner product, norm, normalised vector. Sums run left to right in double, so any engine that does the same gets the same bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product. Null if either is null; lengths have to agree, else null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays as it is."""
    n = F.coalesce(F.nullif(norm(a), F.lit(0.0)), F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def squared_distance(a: Column, b: Column) -> Column:
    """-2 a.b + |b|^2: orders centres b by distance from a."""
    return F.lit(-2.0) * dot(a, b) + dot(b, b)
