"""Tile offsets cover every length, and a small file of long lengths is no single task."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import boxes
from lumenframe.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_starts(spark):
    lengths = [0, 1, 511, 512, 513, 895, 896, 897, 1279, 1280, 1281, 100_000, 8_399_993]
    rows = spark.createDataFrame([(n,) for n in [*lengths, None]], "n int").select("n", boxes.tile_starts(F.col("n")).alias("s")).collect()
    for n, starts in rows:
        assert starts == sorted({*range(0, max((n or 0) - 512, 0) + 1, 384), max((n or 0) - 512, 0)})


def test_texts(spark):
    lengths = [*range(0, 6000), *range(383_000, 386_000), 3_840_512, 3_840_513, 8_399_993, None]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    regular = F.concat(F.array_join(boxes.tile_starts(F.lit(8_399_993)).cast("array<string>"), ","), F.lit(","))
    plain = F.array_join(boxes.tile_starts(F.col("n")).cast("array<string>"), ",")
    assert df.filter(~boxes.tile_text(F.col("n"), regular).eqNullSafe(plain)).count() == 0


def test_texts_are_made_in_many_tasks(spark):
    found = catalogue.QUERIES["tile_positions"](spark, SMALL)
    parts = found.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_texts_of_a_task_are_by_length(spark):
    """Each begins as the one before does, but for its last offset; a writer then keeps little of it."""
    found = catalogue.QUERIES["tile_positions"](spark, SMALL)
    rows = found.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("at"), "length", "starts").orderBy("at").collect()
    assert len(rows) == spark.read.parquet(f"{SMALL}/part.parquet").count()
    for a, b in zip(rows, rows[1:]):
        assert a.p != b.p or a.length <= b.length and b.starts.startswith(a.starts.rpartition(",")[0])
