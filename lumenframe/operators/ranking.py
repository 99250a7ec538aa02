"""Ranks and medians within groups that may hold most of a table.

No task sorts a group. Rows are first counted by value, so a value that a third of all rows share is one
row; values are then counted by level (a whole number that never falls as the value rises, some
thousands to a doubling), levels are summed up in order, and only the values of one level are sorted together.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.lineage import materialised

#: Levels to a doubling of the value.
LEVELS = 2048


def _level(value: Column) -> Column:
    """A whole number that never falls as the value rises."""
    size = F.floor(F.log2(F.greatest(F.abs(value), F.lit(1e-12))) * LEVELS) + 40 * LEVELS
    return F.when(value < 0, -F.greatest(size, F.lit(0))).otherwise(F.greatest(size, F.lit(0))).cast("long")


def placed_values(counts: DataFrame, group: list[str], value: str, sizes: list[str]) -> DataFrame:
    """``counts``, one row for each value of a group, with ``below_<size>``: each count summed over the smaller values."""
    levelled = counts.withColumn("_level", _level(F.col(value)))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    levels = levelled.groupBy(*group, "_level").agg(*[F.sum(n).alias(n) for n in sizes])
    starts = levels.select(*group, "_level", *[F.coalesce(F.sum(n).over(before(*group).orderBy("_level")), F.lit(0)).alias(f"_start_{n}") for n in sizes])
    within = before(*group, "_level").orderBy(value)
    joined = levelled.join(starts, [*group, "_level"])
    return joined.withColumns({f"below_{n}": F.col(f"_start_{n}") + F.coalesce(F.sum(n).over(within), F.lit(0)) for n in sizes}).drop("_level", *[f"_start_{n}" for n in sizes])


def medians(rows: DataFrame, group: list[str], value: str, tests: list[Column]) -> DataFrame:
    """For each group, ``_n<i>`` rows that meet test i and ``_m<i>``, the median of their values."""
    sizes = [f"_n{i}" for i in range(len(tests))]
    counts = materialised(rows.groupBy(*group, F.col(value).alias("_value")).agg(*[F.count_if(t & F.col(value).isNotNull()).alias(n) for n, t in zip(sizes, tests)]))
    placed = placed_values(counts.filter(F.col("_value").isNotNull()), group, "_value", sizes)
    totals = counts.groupBy(*group).agg(*[F.sum(n).alias(f"_t{n}") for n in sizes])
    both = placed.join(totals, group) if group else placed.crossJoin(F.broadcast(totals))

    def at(n: str, place: Column) -> Column:
        below = F.col(f"below_{n}")
        return F.max(F.when((below <= place) & (place < below + F.col(n)), F.col("_value")))

    total = lambda n: F.col(f"_t{n}")
    ends = [F.struct(at(n, F.floor((total(n) - 1) / 2)).alias("low"), at(n, F.floor(total(n) / 2)).alias("high"), F.max(total(n)).alias("n")).alias(f"_s{n}") for n in sizes]
    found = both.groupBy(*group).agg(*ends)
    middle = lambda n: (F.col(f"_s{n}.low").cast("double") + F.col(f"_s{n}.high")) / 2
    return found.select(*group, *[F.col(f"_s{n}.n").alias(n) for n in sizes], *[middle(n).alias(f"_m{i}") for i, n in enumerate(sizes)])


def competition_rank(df: DataFrame, group: list[str], score: str, name: str) -> DataFrame:
    """Adds ``name``: 1 + the rows of the group with a higher score; null where the score is null."""
    counts = df.filter(F.col(score).isNotNull()).groupBy(*group, (-F.col(score)).alias("_value")).agg(F.count("*").alias("_n"))
    ranks = placed_values(counts, group, "_value", ["_n"]).select(*group, (-F.col("_value")).alias(score), (F.col("below__n") + 1).cast("long").alias(name))
    return df.join(ranks, [*group, score], "left").select(*[F.col(c) for c in df.columns], name)


def average_rank(df: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """Adds ``name``: the mean position of equal values in ascending order."""
    counts = df.groupBy(*group, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    ranks = placed_values(counts, group, "_value", ["_n"]).select(*group, F.col("_value").alias(value), (F.col("below__n") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*group, value])


def spearman(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """(group, n, rho, p_value): rank correlation with mean ranks for ties, and its two-sided p.

    The pairs are computed once; ranks are joined to them by value.
    """
    pairs = materialised(df.select(*group, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    ranked = average_rank(average_rank(pairs, group, a, "_ra"), group, b, "_rb")
    found = ranked.groupBy(*group).agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))
    return found.withColumn("p_value", F.pandas_udf(_two_sided, "double")("rho", "n"))


def _two_sided(rho: pd.Series, n: pd.Series) -> pd.Series:
    from lumenframe.operators.evaluation import spearman_p

    return pd.Series([None if r is None or pd.isna(r) else spearman_p(r, int(k)) for r, k in zip(rho, n)], dtype=float)

