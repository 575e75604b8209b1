"""Total, JVM-side expressions for use in record-wise selectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, lo: float, hi: float) -> Column:
    """``value`` held within [lo, hi]; null and NaN count as zero (or the bound nearest to it)."""
    x = value.cast("double")
    empty = min(hi, max(lo, 0.0))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(empty))
        .when(x > hi, F.lit(float(hi)))
        .when(x < lo, F.lit(float(lo)))
        .otherwise(x)
    )


def vector_literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """Inner product of two double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def centred(vector: Column, means: Sequence[float]) -> Column:
    return F.zip_with(vector, vector_literal(means), lambda x, m: x - m)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def nearest(vector: Column, centres: Sequence[Sequence[float]]) -> Column:
    """Index of the nearest centre by Euclidean distance; the first of equally near ones."""
    distances = F.array(*[squared_distance(vector, vector_literal(c)) for c in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def first_item(array: Column) -> Column:
    return F.get(array, F.lit(0))


def glue(path: Column, other: Column) -> Column:
    """``path`` followed by all but the first item of ``other``."""
    return F.concat(path, F.slice(other, F.lit(2), F.greatest(F.size(other), F.lit(0))))
