"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scores
from lumenframe.operators import similarity
from lumenframe.plans.media import COS_SQL, P_SQL
from lumenframe.sources import tables

TARGET = 0


def embedding_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = similarity.unit_vectors(tables.embeddings(spark, sf_dir))
    return u.select("channel", "video_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


def channel_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = similarity.centroids(tables.embeddings(spark, sf_dir))
    return c.select("channel", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


def channel_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.cohesion(tables.embeddings(spark, sf_dir))
    return found.select("channel", "n", *[F.round(c, 6).alias(c) for c in ("mean_cos", "std_cos", "min_cos")])


def channel_cross_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.cross_similarity(tables.embeddings(spark, sf_dir))


def nearest_peer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.nearest_channels(tables.embeddings(spark, sf_dir), TARGET).withColumn("cos", F.round("cos", 6))


def topk_peer_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.embeddings(spark, sf_dir)
    found = similarity.top_neighbours(e.filter(F.col("channel") == TARGET), e.filter(F.col("channel") != TARGET), 5)
    return found.withColumn("cos", F.round("cos", 6))


def visual_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.cos_to_centroid(tables.embeddings(spark, sf_dir)).filter(F.col("channel") == TARGET)
    return found.select("video_id", F.round("cos", 6).alias("cos"))


def calibration_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.agreement(tables.embeddings(spark, sf_dir), tables.quantised(spark, sf_dir))
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("mean_cos", "std_cos", "min_cos", "max_cos")])


def calibration_pairwise_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all rows, pairs between channels too."""
    found = similarity.pairwise_spearman(tables.embeddings(spark, sf_dir), tables.quantised(spark, sf_dir))
    return found.select("n_pairs", F.round("rho", 6).alias("rho"), F.round("p_value", 6).alias("p_value"), scores.agreement_verdict(F.col("rho")).alias("verdict"))


def ordering_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether both models order the peers alike."""
    orders = []
    for name, f in (("a", tables.embeddings), ("b", tables.quantised)):
        ranked = similarity.nearest_channels(f(spark, sf_dir), TARGET)
        orders.append(ranked.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "peer_channel"))), lambda r: r["peer_channel"].cast("string")), ",").alias(name)))
    return orders[0].crossJoin(orders[1]).select(F.col("a").alias("order_a"), F.col("b").alias("order_b"), (F.col("a") == F.col("b")).alias("matches"))


def zero_shot_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The channels' centroids as label texts."""
    e = tables.embeddings(spark, sf_dir)
    labels = similarity.centroids(e).select(F.col("channel").alias("label"), F.col("centroid").alias("embedding"))
    found = similarity.zero_shot(e.select(F.col("video_id").alias("image_id"), "embedding"), labels)
    return found.select("image_id", "label", F.round("sim", 6).alias("sim"), F.round("prob", 5).alias("prob"), "rank")


_Q = """qunit AS (SELECT channel, video_id, list_transform(q, lambda x: x / sqrt(list_inner_product(q, q))) AS v FROM (
  SELECT label AS channel, vec_id AS video_id, list_transform(embedding, lambda x: round(x::DOUBLE * 127) / 127) AS q FROM embeddings))"""
_QCEN = """qlong AS (SELECT channel, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM qunit),
qraw AS (SELECT channel, list(m ORDER BY pos) AS c FROM (SELECT channel, pos, avg(x) AS m FROM qlong GROUP BY channel, pos) GROUP BY channel),
qcen AS (SELECT channel, list_transform(c, lambda x: x / sqrt(list_inner_product(c, c))) AS c FROM qraw)"""
_ORDER = "SELECT string_agg(channel::VARCHAR, ',' ORDER BY cos DESC, channel) AS o FROM (SELECT p.channel, list_inner_product(p.c, t.c) AS cos FROM {0} p, {0} t WHERE t.channel = 0 AND p.channel <> 0)"

QUERIES = {
    f.__name__: f
    for f in (
        embedding_normalize, channel_centroids, channel_cohesion, channel_cross_similarity, nearest_peer_ranking, topk_peer_neighbors, visual_outliers,
        calibration_agreement, calibration_pairwise_spearman, ordering_match, zero_shot_softmax,
    )
}
ORACLE_SQL = {
    "embedding_normalize": f"WITH {COS_SQL} SELECT channel, video_id, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 6) AS x FROM unit",
    "channel_centroids": f"WITH {COS_SQL} SELECT channel, generate_subscripts(c, 1) - 1 AS pos, round(unnest(c), 6) AS x FROM cen",
    "channel_cohesion": f"WITH {COS_SQL} SELECT channel, count(*) AS n, round(avg(cos), 6) AS mean_cos, round(stddev_pop(cos), 6) AS std_cos, round(min(cos), 6) AS min_cos FROM coss GROUP BY channel",
    "channel_cross_similarity": f"WITH {COS_SQL} SELECT a.channel AS channel_a, b.channel AS channel_b, round(list_inner_product(a.c, b.c), 4) AS cos FROM cen a, cen b",
    "nearest_peer_ranking": f"WITH {COS_SQL} SELECT channel AS peer_channel, round(cos, 6) AS cos, row_number() OVER (ORDER BY cos DESC, channel) AS rank FROM (SELECT p.channel, list_inner_product(p.c, t.c) AS cos FROM cen p, cen t WHERE t.channel = 0 AND p.channel <> 0)",
    "topk_peer_neighbors": f"""WITH {COS_SQL}, p AS (SELECT t.video_id AS target_video_id, p.channel AS peer_channel, p.video_id AS peer_video_id, list_inner_product(t.u, p.u) AS cos FROM unit t, unit p WHERE t.channel = 0 AND p.channel <> 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY target_video_id ORDER BY cos DESC, peer_video_id) AS rank FROM p)
      SELECT target_video_id, rank, peer_channel, peer_video_id, round(cos, 6) AS cos FROM r WHERE rank <= 5""",
    "visual_outliers": f"WITH {COS_SQL} SELECT video_id, round(cos, 6) AS cos FROM coss WHERE channel = 0",
    "calibration_agreement": f"WITH {COS_SQL}, {_Q}, j AS (SELECT list_inner_product(u, v) AS cos FROM unit JOIN qunit USING (channel, video_id)) SELECT count(*) AS n, round(avg(cos), 6) AS mean_cos, round(stddev_pop(cos), 6) AS std_cos, round(min(cos), 6) AS min_cos, round(max(cos), 6) AS max_cos FROM j",
    "calibration_pairwise_spearman": f"""WITH {COS_SQL}, {_Q}, j AS (SELECT video_id, u, v FROM unit JOIN qunit USING (channel, video_id)),
      p AS (SELECT round(list_inner_product(a.u, b.u), 9) AS x, round(list_inner_product(a.v, b.v), 9) AS y FROM j a JOIN j b ON a.video_id < b.video_id),
      r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM p),
      c AS (SELECT count(*) AS n, corr(rx::DOUBLE, ry::DOUBLE) AS rho FROM r), {P_SQL}
      SELECT n AS n_pairs, round(rho, 6) AS rho, p_value, CASE WHEN rho >= 0.8 THEN 'strong' WHEN rho >= 0.6 THEN 'moderate' ELSE 'low' END AS verdict FROM c, pv""",
    "ordering_match": f"WITH {COS_SQL}, {_Q}, {_QCEN}, a AS ({_ORDER.format('cen')}), b AS ({_ORDER.format('qcen')}) SELECT a.o AS order_a, b.o AS order_b, a.o = b.o AS matches FROM a, b",
    "zero_shot_softmax": f"""WITH {COS_SQL}, p AS (SELECT video_id AS image_id, cen.channel AS label, list_inner_product(u, c) AS sim FROM unit, cen),
      e AS (SELECT *, exp((sim - max(sim) OVER (PARTITION BY image_id)) / 0.01::DOUBLE) AS e FROM p)
      SELECT image_id, label, round(sim, 6) AS sim, round(e / sum(e) OVER (PARTITION BY image_id), 5) AS prob, row_number() OVER (PARTITION BY image_id ORDER BY sim DESC, label) AS rank FROM e""",
}
