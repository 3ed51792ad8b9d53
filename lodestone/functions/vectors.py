"""Column functions over embedding vectors (``array<float>``), in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    norm = l2_norm(v)
    scale = F.when(norm == 0.0, F.lit(1.0)).otherwise(norm)
    # Repeated into an array, the scale is computed once per vector, not per element.
    return F.zip_with(v, F.array_repeat(scale, F.size(v)), lambda x, s: x.cast("double") / s)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where either side is a zero vector."""
    norms = l2_norm(a) * l2_norm(b)
    return F.when(norms == 0.0, F.lit(0.0)).otherwise(dot(a, b) / norms)


def similarity_from_cosine(cos: Column) -> Column:
    """Similarity in [0, 1] of a cosine *distance* ``1 - cos`` halved: ``1 - d / 2``."""
    return F.lit(1.0) - (F.lit(1.0) - cos) / F.lit(2.0)
