"""Performance of items against their channel: conditional medians with fallback pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import scores
from lumenframe.lineage import materialised
from lumenframe.operators.ranking import competition_rank, medians

MIN_DAYS, WINDOW_DAYS = 7, 365


def with_ages(videos: DataFrame, now: Column, min_days: int = MIN_DAYS, window_days: int | None = WINDOW_DAYS) -> DataFrame:
    """Drops rows without views or date; adds age, views a day, duration and the two flags."""
    age = F.col("days_old")
    rows = videos.filter(F.col("view_count").isNotNull() & F.col("published_at").isNotNull()).withColumn("days_old", scores.days_since(F.col("published_at"), now))
    out = rows.withColumn("views_per_day", scores.per_day(F.col("view_count"), age)).withColumn("is_too_young", age < min_days)
    if "duration_iso8601" in videos.columns:
        out = out.withColumn("duration_seconds", scores.duration_seconds(F.col("duration_iso8601")))
    return out.withColumn("is_in_reference_window", F.lit(True) if window_days is None else age <= window_days)


def ladder(rows: DataFrame, group: list[str], value: str, rungs: list[Column], median: str, size: str, rung: str) -> DataFrame:
    """One row per group: the median of ``value`` over the first rung that has rows (the last: all
    rows), that pool's size, and the rung's number (A1 to A3)."""
    found = medians(rows, group, value, [*rungs, F.lit(True)])
    pick = lambda x: reduce(lambda rest, i: F.when(F.col(f"_n{i}") > 0, x(i)).otherwise(rest), reversed(range(len(rungs))), x(len(rungs)))
    return found.select(
        *group, pick(lambda i: F.col(f"_m{i}")).alias(median), pick(lambda i: F.col(f"_n{i}")).alias(size), pick(lambda i: F.lit(i)).alias(rung)
    )


def channel_reference(aged: DataFrame, group: list[str]) -> DataFrame:
    """One row per channel: reference_median_views, reference_pool_size and the rung used."""
    old = ~F.col("is_too_young")
    return ladder(aged, group, "view_count", [F.col("is_in_reference_window") & old, old], "reference_median_views", "reference_pool_size", "reference_rung")


def outlier_scores(videos: DataFrame, now: Column, group: list[str] | None = None, min_days: int = MIN_DAYS, window_days: int | None = WINDOW_DAYS) -> DataFrame:
    """Every video's views over its channel's reference median, and its rank in the channel."""
    group = group or ["channel"]
    aged = materialised(with_ages(videos, now, min_days, window_days))
    scored = aged.join(channel_reference(aged, group), group)
    score = scores.ratio_to_median(F.col("view_count"), F.col("reference_median_views"), F.col("is_too_young"))
    return competition_rank(scored.withColumn("outlier_score", score), group, "outlier_score", "outlier_rank")


def organic_outlier_scores(
    videos: DataFrame, ad_views: DataFrame, now: Column, group: list[str] | None = None, threshold: int = 0, min_days: int = MIN_DAYS, window_days: int | None = WINDOW_DAYS
) -> DataFrame:
    """``outlier_scores`` and the same over organic views, with promoted videos outside the pool."""
    group = group or ["channel"]
    joined = outlier_scores(videos, now, group, min_days, window_days).join(ad_views.select("video_id", F.col("ad_views").alias("_ads")), "video_id", "left")
    rows = materialised(
        joined.withColumn("ad_views_claimed", F.coalesce("_ads", F.lit(0)).cast("long"))
        .drop("_ads")
        .withColumn("organic_view_count", F.greatest(F.col("view_count") - F.col("ad_views_claimed"), F.lit(0)))
        .withColumn("is_ad_promoted", F.col("ad_views_claimed") > threshold)
    )
    old, organic = ~F.col("is_too_young"), ~F.col("is_ad_promoted")
    rungs = [F.col("is_in_reference_window") & old & organic, old & organic, organic]
    reference = ladder(rows, group, "organic_view_count", rungs, "reference_organic_median_views", "reference_organic_pool_size", "_rung")
    reference = reference.withColumn("organic_fallback_to_raw", F.col("_rung") == 3).drop("_rung")
    score = scores.ratio_to_median(F.col("organic_view_count"), F.col("reference_organic_median_views"), F.col("is_too_young"))
    return competition_rank(rows.join(reference, group).withColumn("organic_outlier_score", score), group, "organic_outlier_score", "organic_outlier_rank")


def roi_organic_scores(roi: DataFrame) -> DataFrame:
    """The report's other definition: organic views over the whole table's median, 1 at least (A4, P10)."""
    rows = materialised(roi.withColumn("organic_views", F.greatest(F.col("view_count") - F.coalesce("promo_views", F.lit(0)), F.lit(0))))
    median = medians(rows, [], "organic_views", [F.lit(True)]).select(F.col("_m0").alias("channel_organic_median"))
    return rows.crossJoin(F.broadcast(median)).withColumn("organic_outlier_score", F.col("organic_views") / F.greatest(F.lit(1.0), F.col("channel_organic_median")))


def tails(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    """The ``n`` lowest and the ``n`` highest rows by ``by``, marked in ``tail`` (W3, W4). Both read ``df`` from one computation."""
    df = materialised(df)
    low = df.filter(F.col(by).isNotNull()).orderBy(F.col(by).asc(), F.col(tie).asc()).limit(n).withColumn("tail", F.lit("low"))
    high = df.filter(F.col(by).isNotNull()).orderBy(F.col(by).desc(), F.col(tie).desc()).limit(n).withColumn("tail", F.lit("high"))
    return low.union(high)
