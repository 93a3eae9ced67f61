"""Arithmetic on ``array<float>`` columns, in double precision, inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def problem(a: Column, dim: int, tolerance: float = 1e-3) -> Column:
    """Why a vector is not a valid unit vector of ``dim`` values: missing, dimension, norm; null if it is."""
    return F.when(a.isNull(), "missing").when(F.size(a) != dim, "dimension").when(F.abs(norm(a) - 1.0) > tolerance, "norm")
