"""Column expressions over arrays of numbers, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a, b) -> Column:
    """Inner product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def scaled(v, by: Column) -> Column:
    """Each element divided by ``by``, or as it is where that is 0."""
    safe = F.when(by == 0, 1.0).otherwise(by)
    return F.transform(v, lambda x: x.cast("double") / safe)


def softmax(v) -> Column:
    """Numerically stable softmax of an array."""
    top = F.array_max(v)
    exps = F.transform(v, lambda x: F.exp(x - top))
    total = F.aggregate(F.transform(v, lambda x: F.exp(x - top)), F.lit(0.0), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def peak_scaled(v, target: float = 0.9) -> Column:
    """Scaled so that the largest magnitude is ``target``; silence stays."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(peak > 1e-6, F.transform(v, lambda x: x * (target / peak))).otherwise(v)
