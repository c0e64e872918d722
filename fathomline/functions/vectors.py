"""Vector expressions in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, b_norm: Column | None = None) -> Column:
    """1 - cosine; NaN where a vector is zero, null where one is null.  Sort with ``asc_nulls_last``."""
    scale = norm(a) * (norm(b) if b_norm is None else b_norm)
    return F.when(scale == 0, F.lit(float("nan"))).otherwise(F.lit(1.0) - dot(a, b) / F.nullif(scale, F.lit(0.0)))
