"""Performance queries: outlier scores, organic scores, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scores
from lumenframe.operators import outliers, ranking, similarity
from lumenframe.sources import tables
from lumenframe.sources.tables import ADS_SQL, VIDEOS_SQL

SCORE_COLUMNS = ("channel", "video_id", "days_old", "views_per_day", "is_too_young", "is_in_reference_window", "reference_median_views", "reference_pool_size", "outlier_score", "outlier_rank")


def outlier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.outlier_scores(tables.videos(spark, sf_dir), tables.now()).select(*SCORE_COLUMNS)


def outlier_median_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    aged = outliers.with_ages(tables.videos(spark, sf_dir), tables.now(), min_days=7, window_days=20)
    return outliers.channel_reference(aged.withColumn("month", F.month("published_at")), ["channel", "month"])


def organic_outlier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.organic_outlier_scores(tables.videos(spark, sf_dir), tables.ad_views(spark, sf_dir), tables.now())
    return found.select(
        "channel", "video_id", "ad_views_claimed", "organic_view_count", "is_ad_promoted", "reference_organic_median_views",
        "reference_organic_pool_size", "organic_fallback_to_raw", "organic_outlier_score", "organic_outlier_rank",
    )


def organic_script_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.roi_organic_scores(tables.roi(spark, sf_dir))


def views_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.with_ages(tables.videos(spark, sf_dir), tables.now()).select("video_id", "days_old", "views_per_day")


def duration_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tables.videos(spark, sf_dir).withColumn("d", F.when(F.col("video_id") % 9 == 0, "P1W").when(F.col("video_id") % 7 == 0, "P1DT2H").when(F.col("video_id") % 5 == 0, "").otherwise(F.col("duration_iso8601")))
    return v.select("video_id", scores.duration_seconds(F.col("d")).alias("seconds"))


def top_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.outlier_scores(tables.videos(spark, sf_dir), tables.now()).select("video_id", "outlier_score")
    return outliers.tails(found, "outlier_score", "video_id", 5)


def _visual_and_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cos = similarity.cos_to_centroid(tables.embeddings(spark, sf_dir)).select("video_id", F.round("cos", 9).alias("cos"))
    return cos.join(outliers.roi_organic_scores(tables.roi(spark, sf_dir)), "video_id")


def spearman_visual_vs_perf(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _visual_and_performance(spark, sf_dir).withColumn("g", F.lit(0))
    rho = ranking.spearman(joined, ["g"], "cos", "organic_outlier_score")
    return rho.select("n", "rho", F.round("p_value", 6).alias("p_value"), scores.direction_verdict(F.col("rho")).alias("verdict"))


def visual_performance_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visual_and_performance(spark, sf_dir).select("video_id", "cos", "view_count", "organic_views", "organic_outlier_score")


_AGED = f"""aged AS (SELECT *, (epoch_us(TIMESTAMP '2001-08-02') - epoch_us(published_at)) / 86400000000.0::DOUBLE AS days_old FROM ({VIDEOS_SQL})),
flags AS (SELECT *, view_count / greatest(1.0::DOUBLE, days_old) AS views_per_day, days_old < 7 AS is_too_young, days_old <= 365 AS is_in_reference_window FROM aged)"""
_SCORED = f"""{_AGED},
ref AS (
  SELECT channel, count(*) FILTER (is_in_reference_window AND NOT is_too_young) AS n0, count(*) FILTER (NOT is_too_young) AS n1, count(*) AS n2,
         median(view_count) FILTER (is_in_reference_window AND NOT is_too_young) AS m0, median(view_count) FILTER (NOT is_too_young) AS m1, median(view_count) AS m2
  FROM flags GROUP BY channel),
scored AS (
  SELECT flags.*, CASE WHEN n0 > 0 THEN m0 WHEN n1 > 0 THEN m1 ELSE m2 END AS reference_median_views,
         CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 ELSE n2 END AS reference_pool_size FROM flags JOIN ref USING (channel)),
raw AS (SELECT *, CASE WHEN NOT is_too_young AND reference_median_views > 0 THEN view_count / reference_median_views END AS outlier_score FROM scored)"""
_ROI = f"""roi AS (SELECT v.video_id, view_count, ad_views AS promo_views FROM ({VIDEOS_SQL}) v LEFT JOIN ({ADS_SQL}) a USING (video_id)),
org AS (SELECT *, greatest(view_count - coalesce(promo_views, 0), 0) AS organic_views FROM roi),
sheet AS (SELECT *, median(organic_views) OVER () AS channel_organic_median FROM org),
script AS (SELECT *, organic_views / greatest(1.0::DOUBLE, channel_organic_median) AS organic_outlier_score FROM sheet)"""
_COS = """unit AS (SELECT label AS channel, vec_id AS video_id, list_transform(embedding, lambda x: x::DOUBLE / CASE WHEN list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 1 ELSE sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) END) AS u FROM embeddings),
long AS (SELECT channel, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit),
mean AS (SELECT channel, pos, avg(x) AS m FROM long GROUP BY channel, pos),
raw_c AS (SELECT channel, list(m ORDER BY pos) AS c FROM mean GROUP BY channel),
cen AS (SELECT channel, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM raw_c),
coss AS (SELECT channel, video_id, list_inner_product(u, c) AS cos FROM unit JOIN cen USING (channel))"""

# Two-sided p of a rank correlation: the t distribution's middle as an integral of cos(x) ** (degrees - 1), by Simpson's rule.
_P = """th AS (SELECT n, n - 2 AS dof, atan(abs(rho) * sqrt((n - 2) / (1 - rho * rho)) / sqrt(n - 2)) AS theta FROM c),
pt AS (SELECT dof, theta, CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * pow(cos(theta * k / 20000), dof - 1) AS f FROM th, (SELECT unnest(generate_series(0, 20000))::DOUBLE AS k)),
pv AS (SELECT round(greatest(0, 1 - 2 / sqrt(pi()) * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) * theta / 60000 * sum(f)), 6) AS p_value FROM pt GROUP BY dof, theta)"""

QUERIES = {
    f.__name__: f
    for f in (
        outlier_scores, outlier_median_ladder, organic_outlier_scores, organic_script_variant, views_per_day, duration_parse, top_bottom_k,
        spearman_visual_vs_perf, visual_performance_join,
    )
}
ORACLE_SQL = {
    "outlier_scores": f"WITH {_SCORED} SELECT {', '.join(SCORE_COLUMNS[:-1])}, CASE WHEN outlier_score IS NOT NULL THEN rank() OVER (PARTITION BY channel ORDER BY outlier_score DESC NULLS LAST) END AS outlier_rank FROM raw",
    "outlier_median_ladder": f"""WITH {_AGED}, f AS (SELECT *, month(published_at)::INT AS month, days_old <= 20 AS near FROM flags),
      r AS (SELECT channel, month, count(*) FILTER (near AND NOT is_too_young) AS n0, count(*) FILTER (NOT is_too_young) AS n1, count(*) AS n2,
        median(view_count) FILTER (near AND NOT is_too_young) AS m0, median(view_count) FILTER (NOT is_too_young) AS m1, median(view_count) AS m2 FROM f GROUP BY channel, month)
      SELECT channel, month, CASE WHEN n0 > 0 THEN m0 WHEN n1 > 0 THEN m1 ELSE m2 END AS reference_median_views,
        CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 ELSE n2 END AS reference_pool_size, CASE WHEN n0 > 0 THEN 0 WHEN n1 > 0 THEN 1 ELSE 2 END AS reference_rung FROM r""",
    "organic_outlier_scores": f"""WITH {_AGED},
      o AS (SELECT flags.*, coalesce(ad_views, 0) AS ad_views_claimed, greatest(view_count - coalesce(ad_views, 0), 0) AS organic_view_count, coalesce(ad_views, 0) > 0 AS is_ad_promoted
        FROM flags LEFT JOIN ({ADS_SQL}) USING (video_id)),
      t AS (SELECT *, NOT is_too_young AND NOT is_ad_promoted AS t1, NOT is_too_young AND NOT is_ad_promoted AND is_in_reference_window AS t0 FROM o),
      ref AS (SELECT channel, count(*) FILTER (t0) AS n0, count(*) FILTER (t1) AS n1, count(*) FILTER (NOT is_ad_promoted) AS n2, count(*) AS n3,
        median(organic_view_count) FILTER (t0) AS m0, median(organic_view_count) FILTER (t1) AS m1, median(organic_view_count) FILTER (NOT is_ad_promoted) AS m2, median(organic_view_count) AS m3
        FROM t GROUP BY channel),
      s AS (SELECT t.*, CASE WHEN n0 > 0 THEN m0 WHEN n1 > 0 THEN m1 WHEN n2 > 0 THEN m2 ELSE m3 END AS reference_organic_median_views,
        CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS reference_organic_pool_size, n2 = 0 AS organic_fallback_to_raw FROM t JOIN ref USING (channel)),
      z AS (SELECT *, CASE WHEN NOT is_too_young AND reference_organic_median_views > 0 THEN organic_view_count / reference_organic_median_views END AS organic_outlier_score FROM s)
      SELECT channel, video_id, ad_views_claimed, organic_view_count, is_ad_promoted, reference_organic_median_views, reference_organic_pool_size, organic_fallback_to_raw, organic_outlier_score,
        CASE WHEN organic_outlier_score IS NOT NULL THEN rank() OVER (PARTITION BY channel ORDER BY organic_outlier_score DESC NULLS LAST) END AS organic_outlier_rank FROM z""",
    "organic_script_variant": f"WITH {_ROI} SELECT * FROM script",
    "views_per_day": f"WITH {_AGED} SELECT video_id, days_old, views_per_day FROM flags",
    "duration_parse": """SELECT o_orderkey AS video_id, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 93600.0::DOUBLE WHEN o_orderkey % 5 = 0 THEN NULL
      ELSE (o_orderkey % 5000)::DOUBLE END AS seconds FROM orders""",
    "top_bottom_k": f"""WITH {_SCORED}, s AS (SELECT video_id, outlier_score FROM raw WHERE outlier_score IS NOT NULL)
      (SELECT *, 'low' AS tail FROM s ORDER BY outlier_score, video_id LIMIT 5) UNION ALL (SELECT *, 'high' AS tail FROM s ORDER BY outlier_score DESC, video_id DESC LIMIT 5)""",
    "spearman_visual_vs_perf": f"""WITH {_ROI}, {_COS}, j AS (SELECT round(cos, 9) AS a, organic_outlier_score AS b FROM coss JOIN script USING (video_id)),
      r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j),
      c AS (SELECT count(*) AS n, corr(ra::DOUBLE, rb::DOUBLE) AS rho FROM r), {_P}
      SELECT n, rho, p_value, CASE WHEN abs(rho) < 0.2 THEN 'uncorrelated' WHEN rho > 0 THEN 'typical_better' ELSE 'unusual_better' END AS verdict FROM c, pv""",
    "visual_performance_join": f"WITH {_ROI}, {_COS} SELECT video_id, round(cos, 9) AS cos, view_count, organic_views, organic_outlier_score FROM coss JOIN script USING (video_id)",
}
COS_SQL, P_SQL = _COS, _P
