"""Dense vectors held as ``array<double>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanspark.config import EPSILON


def as_doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_normalise(vector: Column) -> Column:
    """x / (|x| + 1e-9): a zero vector stays zero."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))
    # The length is computed once per row by carrying it in a one-element array.
    scaled = F.transform(
        F.array(norm + F.lit(EPSILON)), lambda n: F.transform(vector, lambda x: x / n)
    )
    return F.get(scaled, F.lit(0))


def clip_unit(value: Column) -> Column:
    """Clip to [0, 1]; NULL stays NULL."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
