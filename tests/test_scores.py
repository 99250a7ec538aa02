"""Outlier scores, durations and ranks against values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import scores
from lumenframe.operators import outliers, ranking

NOW = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
VIDEOS = "channel string, video_id string, view_count long, published_at timestamp"


def videos(spark, rows):
    return spark.createDataFrame([("x", v, n, NOW - dt.timedelta(days=d)) for v, n, d in rows], VIDEOS)


GOLDEN = [("a", 100, 30), ("b", 300, 60), ("c", 1000, 3), ("d", 50, 400)]


def test_golden_channel(spark):
    ads = spark.createDataFrame([("b", 150)], "video_id string, ad_views long")
    rows = {r["video_id"]: r for r in outliers.organic_outlier_scores(videos(spark, GOLDEN), ads, F.lit(NOW)).collect()}
    assert {v: (r["outlier_score"], r["outlier_rank"]) for v, r in rows.items()} == {"a": (0.5, 2), "b": (1.5, 1), "c": (None, None), "d": (0.25, 3)}
    assert {v: (r["organic_outlier_score"], r["organic_outlier_rank"]) for v, r in rows.items()} == {"a": (1.0, 2), "b": (1.5, 1), "c": (None, None), "d": (0.5, 3)}
    assert {(r["reference_median_views"], r["reference_pool_size"], r["reference_organic_median_views"], r["reference_organic_pool_size"]) for r in rows.values()} == {(200.0, 2, 100.0, 1)}
    assert rows["b"]["is_ad_promoted"] and rows["b"]["organic_view_count"] == 150 and not rows["a"]["organic_fallback_to_raw"]


@pytest.mark.parametrize(
    ("rows", "median", "size"),
    [([("a", 10, 1), ("b", 30, 2)], 20.0, 2), ([("a", 10, 1), ("b", 30, 500)], 30.0, 1), ([("a", 0, 20)], 0.0, 1)],
)
def test_ladder_rungs(spark, rows, median, size):
    found = outliers.outlier_scores(videos(spark, rows), F.lit(NOW)).collect()
    assert {(r["reference_median_views"], r["reference_pool_size"]) for r in found} == {(median, size)}
    if median == 0 or all(d < 7 for *_, d in rows):
        assert all(r["outlier_score"] is None and r["outlier_rank"] is None for r in found)


def test_all_promoted_falls_back(spark):
    ads = spark.createDataFrame([("a", 5), ("b", 5)], "video_id string, ad_views long")
    found = outliers.organic_outlier_scores(videos(spark, GOLDEN[:2]), ads, F.lit(NOW)).collect()
    assert all(r["organic_fallback_to_raw"] and r["reference_organic_median_views"] == 195.0 for r in found)


def test_rows_without_views_or_date_go(spark):
    df = spark.createDataFrame([("x", "a", None, NOW), ("x", "b", 5, None)], VIDEOS)
    assert outliers.outlier_scores(df, F.lit(NOW)).count() == 0


def test_durations(spark):
    want = {"PT12M34S": 754.0, "P1DT2H": 93600.0, "PT1.5S": 1.5, "PT": 0.0, "P": 0.0, "P1W": None, "12:34": None, "": None, None: None}
    df = spark.createDataFrame([(d,) for d in want], "d string")
    assert {r["d"]: r["s"] for r in df.select("d", scores.duration_seconds(F.col("d")).alias("s")).collect()} == want


def test_ranks_tie_and_skip(spark):
    values = [5.0, 3.0, 3.0, 1.0, None, -2.0, -2.0, 1e9, 0.0]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    got = {r["i"]: r["r"] for r in ranking.competition_rank(df, ["g"], "v", "r").collect()}
    known = [v for v in values if v is not None]
    assert got == {i: None if v is None else 1 + sum(o > v for o in known) for i, v in enumerate(values)}
    mean = {r["i"]: r["r"] for r in ranking.average_rank(df.filter("v IS NOT NULL"), ["g"], "v", "r").collect()}
    assert all(mean[i] == sum(o < v for o in known) + (known.count(v) + 1) / 2 for i, v in enumerate(values) if v is not None)


def test_spearman(spark):
    df = spark.createDataFrame([(0, a, b) for a, b in zip([1.0, 2.0, 2.0, 4.0], [4.0, 1.0, 3.0, 2.0])], "g int, a double, b double")
    r = ranking.spearman(df, ["g"], "a", "b").first()
    assert r["n"] == 4 and r["rho"] == pytest.approx(-0.6324555, abs=1e-6)


def test_verdicts(spark):
    df = spark.createDataFrame([(0.9,), (0.7,), (0.1,), (-0.5,)], "r double")
    rows = df.select(scores.agreement_verdict(F.col("r")), scores.direction_verdict(F.col("r"))).collect()
    assert [tuple(r) for r in rows] == [("strong", "typical_better"), ("moderate", "typical_better"), ("low", "uncorrelated"), ("low", "unusual_better")]
