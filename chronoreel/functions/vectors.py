"""Vector expressions; sums run in double precision, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column, least: float = 1e-12) -> Column:
    """v over its length, or over ``least`` if that is longer."""
    norm = F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)), F.lit(least))
    return F.transform(v, lambda x: x / norm)


def clamp(x: Column, low: float = -1.0, high: float = 1.0) -> Column:
    """x held to [low, high]; NaN stays NaN."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), x)))


def even_picks(n: Column, k: Column | int) -> Column:
    """k positions spread evenly over 0..n-1, ends included, halves to even; repeats if k > n; none if n or k is 0."""
    k = F.lit(k) if isinstance(k, int) else k
    one = F.array(F.lit(0))
    many = F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(2)) - 1), lambda i: F.rint((n - 1) * i / (F.greatest(k, F.lit(2)) - 1)).cast("int"))
    return F.when((n <= 0) | (k <= 0), F.array().cast("array<int>")).when(k == 1, one).otherwise(many)


def uniform_picks(n: Column, budget: Column | int) -> Column:
    """All of 0..n-1 if they fit the budget, else ``budget`` even picks."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= budget, F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)).otherwise(even_picks(n, budget))
