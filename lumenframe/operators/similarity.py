"""Embedding tables: centroids, cohesion, neighbours, agreement of two models.

Vectors are (channel, video_id, embedding). A table that is compared with all rows of another is
met in blocks: each task holds one block of the queries as a matrix. Nothing relies on a side
being small except centroids, one per channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenframe.functions import vectors
from lumenframe.lineage import materialised
from lumenframe.operators import pair_ranks
from lumenframe.operators.ranking import spearman


def unit_vectors(emb: DataFrame) -> DataFrame:
    """Each embedding at unit length, zero vectors as they are."""
    return emb.withColumn("embedding", vectors.scaled("embedding", vectors.norm("embedding")))


def centroids(emb: DataFrame) -> DataFrame:
    """(channel, n, centroid): the mean unit vector of each channel at unit length again (A5)."""
    long = unit_vectors(emb).select("channel", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("channel", "pos").agg(F.avg("x").alias("m"), F.count("*").alias("n"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"])
    found = means.groupBy("channel").agg(F.max("n").alias("n"), mean.alias("c"))
    return found.select("channel", "n", vectors.scaled("c", vectors.norm("c")).alias("centroid"))


def cos_to_centroid(emb: DataFrame) -> DataFrame:
    """(channel, video_id, cos): each row's cosine with its channel's centroid."""
    c = centroids(emb).select("channel", "centroid")
    return unit_vectors(emb).join(c, "channel").select("channel", "video_id", vectors.dot("embedding", "centroid").alias("cos"))


def cohesion(emb: DataFrame) -> DataFrame:
    """How tightly each channel clusters: count, mean, population deviation, minimum."""
    return cos_to_centroid(emb).groupBy("channel").agg(
        F.count("*").alias("n"), F.avg("cos").alias("mean_cos"), F.stddev_pop("cos").alias("std_cos"), F.min("cos").alias("min_cos")
    )


def cross_similarity(emb: DataFrame) -> DataFrame:
    """(channel_a, channel_b, cos): all pairs of centroids, each with itself too.

    One row per channel stands on either side: the output itself is their square.
    """
    c = centroids(emb)
    a, b = (c.select(F.col("channel").alias(f"channel_{s}"), F.col("centroid").alias(f"c_{s}")) for s in "ab")
    return a.crossJoin(b).select("channel_a", "channel_b", F.round(vectors.dot("c_a", "c_b"), 4).alias("cos"))


def nearest_channels(emb: DataFrame, target: int | str) -> DataFrame:
    """(peer_channel, cos, rank): other channels by their centroid's cosine with the target's."""
    c = centroids(emb)
    t = c.filter(F.col("channel") == target).select(F.col("centroid").alias("t"))
    scored = c.filter(F.col("channel") != target).crossJoin(t).select(F.col("channel").alias("peer_channel"), vectors.dot("centroid", "t").alias("cos"))
    order = Window.orderBy(F.col("cos").desc(), F.col("peer_channel"))
    return scored.withColumn("rank", F.row_number().over(order).cast("long"))


def top_neighbours(targets: DataFrame, peers: DataFrame, k: int = 5, block: int = 4096, splits: int | None = None) -> DataFrame:
    """The ``k`` peers of highest cosine of each target (J8, W2, T5): (target_video_id, rank,
    peer_channel, peer_video_id, cos). Equal cosines go by peer_video_id.

    Targets are dealt into blocks and peers into ``splits``; each block meets each split in one group of one
    shuffle. A task holds a block as a matrix, streams the split past it and keeps the best ``k`` of each target, so no
    pair is ever a row and nothing is collected.
    """
    blocks = max(1, -(-targets.count() // block))
    splits = splits or int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = unit_vectors(targets).select(F.lit(None).cast(peers.schema["channel"].dataType).alias("channel"), "video_id", "embedding")
    p = unit_vectors(peers).select("channel", "video_id", "embedding")
    part = lambda n: F.pmod(F.xxhash64("video_id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = t.select(part(blocks).alias("block"), each(splits).alias("split"), F.lit(0).alias("kind"), "*")
    p = p.select(each(blocks).alias("block"), part(splits).alias("split"), F.lit(1).alias("kind"), "*")
    kinds = {f.name: f.dataType for f in p.schema.fields}
    schema = T.StructType([
        T.StructField("target_video_id", kinds["video_id"]), T.StructField("peer_channel", kinds["channel"]),
        T.StructField("peer_video_id", kinds["video_id"]), T.StructField("cos", T.DoubleType()),
    ])
    arrow_kinds = [to_arrow_type(f.dataType) for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, best = None, [], [], None

        def close() -> Iterator[pa.RecordBatch]:
            if best is not None:
                width = best[0].shape[1]
                columns = [np.repeat(np.array(ids, object), width).tolist(), best[2].ravel().tolist(), best[1].ravel().tolist(), best[0].ravel().tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, arrow_kinds)], names=schema.names)

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            edges = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
                if start == end:
                    continue
                piece = batch.slice(start, end - start)
                if tuple(at[start, :2]) != key:
                    yield from close()
                    key, ids, rows, best = tuple(at[start, :2]), [], [], None
                vectors_ = piece.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1)
                names = np.array(piece.column(4).to_pylist())
                if at[start, 2] == 0:
                    ids += names.tolist()
                    rows.append(vectors_)
                elif ids:
                    wide = (len(ids), len(piece))
                    new = (np.concatenate(rows) @ vectors_.T, np.broadcast_to(names, wide), np.broadcast_to(np.array(piece.column(3).to_pylist(), object), wide))
                    both = new if best is None else tuple(np.concatenate([a, b], axis=1) for a, b in zip(best, new))
                    order = np.lexsort((both[1], -both[0]), axis=1)[:, :k]
                    best = tuple(np.take_along_axis(x, order, axis=1) for x in both)
        yield from close()

    dealt = t.union(p).repartition("block", "split").sortWithinPartitions("block", "split", "kind")
    order = Window.partitionBy("target_video_id").orderBy(F.col("cos").desc(), F.col("peer_video_id"))
    ranked = dealt.mapInArrow(run, schema).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k)
    return ranked.select("target_video_id", "rank", "peer_channel", "peer_video_id", "cos")


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two models' tables with equal keys, side by side (J11); raises where keys differ."""
    keys = ["channel", "video_id"]
    left, right = (unit_vectors(x).select(*keys, F.col("embedding").alias(n)) for x, n in ((a, "a"), (b, "b")))
    both = left.join(right, keys, "full")
    return both.withColumn("a", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("a")).otherwise(F.raise_error(F.lit("row alignment mismatch"))))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean, deviation and extremes of each row's cosine between two models."""
    cos = aligned(a, b).select(vectors.dot("a", "b").alias("cos"))
    return cos.agg(F.count("*").alias("n"), F.avg("cos").alias("mean_cos"), F.stddev_pop("cos").alias("std_cos"), F.min("cos").alias("min_cos"), F.max("cos").alias("max_cos"))


#: Pairs at most that are kept as rows and sorted.
SORTED = 1 << 22


def pairwise_spearman(a: DataFrame, b: DataFrame, block: int = 512) -> DataFrame:
    """Rank correlation of the two models' similarities over all pairs of rows (J10, A12, A13): (n_pairs, rho, p_value).

    The result is of all pairs by definition, so this is for a stated set of items, not a whole corpus. Rows are
    dealt into blocks; each two blocks meet once, as matrices. Few pairs are sorted; more are counted by level
    and made again, so that none is kept. Only where six digits can't be told that way are they sorted all the same.
    """
    rows = materialised(aligned(a, b).select(F.xxhash64("channel", "video_id").alias("k"), "a", "b"))
    n = rows.count()
    if n * (n - 1) // 2 > SORTED and (found := pair_ranks.correlation(rows, n)):
        return rows.sparkSession.createDataFrame([(n * (n - 1) // 2, *found)], "n_pairs long, rho double, p_value double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sims in pair_ranks.similarities(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.round(s, 9)) for s in sims], names=["sim_a", "sim_b"])

    met = pair_ranks.met(rows, max(1, -(-n // block)))
    dealt = met.repartition("low", "high").sortWithinPartitions("low", "high", "side")
    sims = dealt.mapInArrow(run, "sim_a double, sim_b double")
    return spearman(sims, [], "sim_a", "sim_b").select(F.col("n").alias("n_pairs"), "rho", "p_value")


def zero_shot(images: DataFrame, labels: DataFrame, temperature: float = 0.01) -> DataFrame:
    """(image_id, label, sim, prob, rank): softmax of cosines over a stated list of labels."""
    pairs = unit_vectors(images).crossJoin(F.broadcast(unit_vectors(labels).select("label", F.col("embedding").alias("l"))))
    scored = pairs.select("image_id", "label", vectors.dot("embedding", "l").alias("sim"))
    each = Window.partitionBy("image_id")
    e = F.exp((F.col("sim") - F.max("sim").over(each)) / temperature)
    scored = scored.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(each)).drop("e")
    return scored.withColumn("rank", F.row_number().over(each.orderBy(F.col("sim").desc(), F.col("label"))).cast("long"))
