"""Vector functions over arrays, for small batches and expressions inside queries.

Bulk scoring uses Arrow batches and matrix products (operators.search); these stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalized(v: Column) -> Column:
    """Unit vector; all zeros where the length is zero or not finite."""
    n = norm(v)
    good = (n > 0) & ~F.isnan(n) & (n < F.lit(float("inf")))
    return F.transform(v, lambda x: F.when(good, x.cast("double") / n).otherwise(0.0))


def true_cosine(a: Column, b: Column) -> Column:
    """Inner product over the product of lengths; 0 where that is tiny."""
    scale = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(scale > 1e-12, dot(a, b) / scale).otherwise(0.0)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))


def ternary(v: Column, alpha: float = 0.3) -> Column:
    """Signs of the elements beyond alpha / sqrt(dimension), else 0."""
    limit = F.lit(alpha) / F.sqrt(F.size(v))
    return F.transform(v, lambda x: F.when(x > limit, 1).when(x < -limit, -1).otherwise(0))


def ternary_dot(a: Column, b: Column) -> Column:
    """Agreements minus disagreements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0), lambda s, x: s + x)
