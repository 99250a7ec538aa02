"""The supplied tables seen as the inputs of the media operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    """The fixed time that ages are counted to."""
    return F.lit("2001-08-02 00:00:00").cast("timestamp")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos, the customer's nation as channel, the price as views."""
    channel = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("channel"))
    seconds = F.col("o_orderkey") % 5000
    duration = F.concat(F.lit("PT"), F.floor(seconds / 60).cast("string"), F.lit("M"), (seconds % 60).cast("string"), F.lit("S"))
    return table(spark, sf_dir, "orders").join(channel, "o_custkey").select(
        "channel", F.col("o_orderkey").alias("video_id"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.floor("o_totalprice").cast("long").alias("view_count"), duration.alias("duration_iso8601"),
    )


def ad_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned quantities of an order as its views from advertisements."""
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    return lines.groupBy(F.col("l_orderkey").alias("video_id")).agg(F.sum(F.col("l_quantity").cast("long") * 100).alias("ad_views"))


def roi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, view_count, promo_views): the sheet of paid views, null where nothing was paid."""
    ads = ad_views(spark, sf_dir).withColumnRenamed("ad_views", "promo_views")
    return videos(spark, sf_dir).select("video_id", "view_count").join(ads, "video_id", "left")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("channel"), F.col("vec_id").alias("video_id"), "embedding")


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an 8-bit model would give them."""
    return embeddings(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double") * 127) / 127))


TITLE_PARTS = ("¿Vale la pena? ", "MEJOR ", "Prueba: ", "TOP 5 ", "No compres ", "#1 ", "")
TITLE_ENDS = (" 2024", " vs Model Y", " | $70 millones", " @canal review", " 12025", " #auto #top", " usd 500!", " CR-V 2019")


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, title): parts' names dressed up as titles, in place of a title table."""
    p = table(spark, sf_dir, "part")
    opening = F.element_at(F.array(*map(F.lit, TITLE_PARTS)), (F.col("p_partkey") % len(TITLE_PARTS) + 1).cast("int"))
    ending = F.element_at(F.array(*map(F.lit, TITLE_ENDS)), (F.col("p_partkey") % len(TITLE_ENDS) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % 3 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return p.select(F.col("p_partkey").alias("video_id"), F.concat(opening, name, F.lit(" "), F.col("p_brand"), ending).alias("title"))


#: The same titles for the SQL side.
TITLES_SQL = f"""SELECT p_partkey AS video_id, ({list(TITLE_PARTS)})[p_partkey % {len(TITLE_PARTS)} + 1]
  || CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) ELSE p_name END || ' ' || p_brand
  || ({list(TITLE_ENDS)})[p_partkey % {len(TITLE_ENDS)} + 1] AS title FROM part"""
VIDEOS_SQL = """SELECT c_nationkey AS channel, o_orderkey AS video_id, o_orderdate::TIMESTAMP AS published_at, floor(o_totalprice)::BIGINT AS view_count
  FROM orders JOIN customer ON o_custkey = c_custkey"""
ADS_SQL = "SELECT l_orderkey AS video_id, sum(l_quantity::BIGINT * 100)::BIGINT AS ad_views FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey"


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as busy intervals of a user, as many seconds long as their value; null values are open."""
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), start.alias("start_ms"), (start + F.floor(F.abs("value") * 1000).cast("long")).alias("end_ms"))


BOX = "array<struct<x:int,y:int,w:int,h:int,score:double,class_id:int,box_id:int>>"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, boxes): the lines of an order as boxes of an image of 640 by 640."""
    b = F.struct(
        (F.col("l_partkey") % 97).cast("int").alias("x"), (F.col("l_suppkey") % 89).cast("int").alias("y"), (F.col("l_quantity") * 2 + 20).cast("int").alias("w"),
        (F.col("l_quantity") + 20).cast("int").alias("h"), F.round(F.col("l_discount") * 10, 4).alias("score"), (F.col("l_linenumber") % 2).cast("int").alias("class_id"),
        F.col("l_linenumber").cast("int").alias("box_id"),
    )
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image_id")).agg(F.array_sort(F.collect_list(b)).alias("boxes"))


def labelled_text(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Truth and predictions (video_id, brands, models, years, keywords) made from titles and perturbed ones."""
    t = titles(spark, sf_dir)
    k = F.col("video_id")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))
    brands, models, words = ("vw", "Chevy", "alfa", "kia", " "), ("CRV", "id.buzz", "civic"), ("electricos", "nuevas", "diesel", "mejores")

    def fresh(shift: int) -> Column:
        new = ("Nuevo", "estreno", "opinión")
        return F.when(k % 4 == shift, F.array().cast("array<string>")).otherwise(F.array(pick(new, k), pick(new, k + shift)))

    def side(shift: int) -> DataFrame:
        return t.filter(k % 11 != shift).select(
            "video_id", F.array(pick(brands, k), pick(brands, k + shift)).alias("brands"), F.array(pick(models, k * (1 + shift))).alias("models"),
            F.array((F.lit(2010) + k % (5 + shift)).cast("int")).alias("years"), F.create_map(F.lit("powertrain"), F.array(pick(words, k + shift * (k % 3))), F.lit("freshness"), fresh(shift)).alias("keywords"),
        )

    return side(0), side(1)


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(video_id, truth, predicted): benchmark texts and misread copies of them."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("video_id"), F.translate("text", "ß", "s").alias("truth"))
    return b.withColumn("predicted", F.upper(F.regexp_replace(F.regexp_replace("truth", "th", "t h"), "e", "3")))
