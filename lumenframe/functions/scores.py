"""Column expressions for ages, durations and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DURATION = r"^\s*P(?:([0-9]+)D)?(?:T(?:([0-9]+)H)?(?:([0-9]+)M)?(?:([0-9]+(?:\.[0-9]+)?)S)?)?\s*$"


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration of days to seconds; null where it is not one or empty."""
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, _DURATION, i), F.lit("")).cast("double"), F.lit(0.0))
    return F.when(text.rlike(_DURATION), part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4))


def days_since(published: Column, now: Column) -> Column:
    """Days, with fractions, from ``published`` to ``now``; may be negative."""
    return (F.unix_micros(now) - F.unix_micros(published)) / F.lit(8.64e10)


def per_day(views: Column, age: Column) -> Column:
    """Views a day, the age being one day at least (D3)."""
    return views / F.greatest(F.lit(1.0), age)


def ratio_to_median(views: Column, median: Column, too_young: Column) -> Column:
    """The outlier score; null where the item is too young or the median is not positive."""
    return F.when(~too_young & (median > 0), views / median)


def agreement_verdict(rho: Column) -> Column:
    """Strong, moderate or low rank agreement."""
    return F.when(rho >= 0.8, "strong").when(rho >= 0.6, "moderate").otherwise("low")


def direction_verdict(rho: Column) -> Column:
    """Whether more typical items do better."""
    return F.when(F.abs(rho) < 0.2, "uncorrelated").when(rho > 0, "typical_better").otherwise("unusual_better")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0 to 1; 0 where all values are equal."""
    return F.when(high == low, 0.0).otherwise((value - low) / (high - low))


def sigmoid(x: Column) -> Column:
    """1 / (1 + e^-x)."""
    return 1 / (1 + F.exp(-x))


def floor_ms(nanos: Column) -> Column:
    """Whole milliseconds of nanoseconds, rounded down."""
    return F.floor(nanos / 1_000_000).cast("long")
