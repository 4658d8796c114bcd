"""Array<float> helpers as higher-order SQL functions (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    prod = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def l2norm(a) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(a) -> Column:
    """Scale to unit length (cosine becomes a dot product)."""
    # the length is bound once, not found again for each element
    return F.element_at(F.transform(F.array(l2norm(a)), lambda n: F.transform(_c(a), lambda x: x.cast("double") / n)), 1)


def cosine(a, b) -> Column:
    return dot(a, b) / (l2norm(a) * l2norm(b))
