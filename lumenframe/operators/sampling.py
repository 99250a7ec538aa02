"""Stratified samples, latest rows, busy time and fixed chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stratified(items: DataFrame, target: Column, per_stratum: int, seed: int = 42, stratum: str = "channel", key: str = "video_id") -> DataFrame:
    """All rows of the target and exactly ``per_stratum`` of each other stratum, by a seeded hash (G1).

    Raises where a stratum has fewer. Spark keeps only the first rows of each stratum before the
    shuffle, so a large one is never sorted whole.
    """
    order = Window.partitionBy(stratum).orderBy(F.md5(F.concat_ws("#", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key))
    chosen = items.filter(~target).withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= per_stratum).drop("_k")
    short = items.filter(~target).groupBy(stratum).agg(F.count("*").alias("n")).filter(F.col("n") < per_stratum).limit(1).collect()
    if short:
        raise ValueError(f"stratum {short[0][0]} has only {short[0][1]} rows, need {per_stratum}")
    return items.filter(target).unionByName(chosen)


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order`` (S3), by an aggregate that combines before the shuffle."""
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.col(order)).alias("r")).select("r.*")


def busy_time(intervals: DataFrame, now: Column, key: str = "key", slot_ms: int = 86_400_000) -> DataFrame:
    """(key, busy_ms, summed_ms, n): length of the union of [start_ms, end_ms), open ends running to ``now``.

    Intervals are cut at multiples of ``slot_ms``, so that a busy key is merged slot by slot.
    """
    end = F.least(F.coalesce("end_ms", now), now)
    rows = intervals.select(key, F.col("start_ms").alias("s"), end.alias("e")).filter("e > s")
    cut = rows.select(key, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / slot_ms), F.floor((F.col("e") - 1) / slot_ms))).alias("slot"))
    part = cut.select(key, "slot", F.greatest("s", F.col("slot") * slot_ms).alias("s"), F.least("e", (F.col("slot") + 1) * slot_ms).alias("e"))
    before = Window.partitionBy(key, "slot").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before), F.col("s"))), F.lit(0))
    union = part.withColumn("fresh", fresh).groupBy(key).agg(F.sum("fresh").alias("busy_ms"))
    return union.join(rows.groupBy(key).agg(F.sum(F.col("e") - F.col("s")).alias("summed_ms"), F.count("*").alias("n")), key)


def duty_cycle(samples: DataFrame, key: str = "key") -> DataFrame:
    """Busy time over wall time since each key's sample before."""
    order = Window.partitionBy(key).orderBy("updated_ms")
    busy, wall = (F.col(c) - F.lag(c).over(order) for c in ("busy_ms", "updated_ms"))
    return samples.withColumn("duty", F.try_divide(busy, wall))


def chunks(signals: DataFrame, rate: int = 16_000, seconds: int = 5, most_seconds: int = 60) -> DataFrame:
    """(key, chunk, samples): fixed chunks of a signal, the last padded with zeros, up to a cap."""
    size = rate * seconds
    s = F.slice("samples", 1, rate * most_seconds)
    each = signals.withColumn("s", s).filter(F.size("s") > 0).select("key", "s", F.explode(F.sequence(F.lit(0), F.floor((F.size("s") - 1) / size).cast("int"))).alias("chunk"))
    piece = F.slice("s", F.col("chunk") * size + 1, F.lit(size))
    return each.select("key", "chunk", F.concat(piece, F.array_repeat(F.lit(0.0).cast("float"), F.lit(size) - F.size(piece))).alias("samples"))


def geometric_mean(views: DataFrame) -> DataFrame:
    """(key, t, class_id, p): mean over views of log probabilities, at unit sum again (N17). Views: (key, view, t, class_id, p)."""
    mean = views.groupBy("key", "t", "class_id").agg(F.exp(F.avg(F.ln(F.col("p") + 1e-9))).alias("g"))
    return mean.withColumn("p", F.col("g") / F.sum("g").over(Window.partitionBy("key", "t"))).drop("g")


def global_sigmoid(scores: DataFrame, key: str = "key") -> DataFrame:
    """(…, applied): a sigmoid over all of a key's scores if any lies outside 0 to 1."""
    out = scores.groupBy(key).agg(((F.min("score") < 0) | (F.max("score") > 1)).alias("applied"))
    return scores.join(out, key).withColumn("score", F.when(F.col("applied"), 1 / (1 + F.exp(-F.col("score")))).otherwise(F.col("score")))
