"""Queries of this subpackage over the supplied tables, and the SQL that some are compared with."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import (
    bpe, chat_format, decontaminate, line_dedup, oracles, quality_knn, quality_rules, sharding, simhash_dedup, suffix_dedup, toxic_segments,
)
from lumenframe.llm.words import documents

VOCABULARY = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(spans: str) -> Column:
    """``start-end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.perspectives(_table(spark, sf_dir, "conversations")).withColumn("spans", _spans("spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.policy_mask("base"))) != 0
    first = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    more = [m for m in quality_rules.MEASURES if m not in first]
    return rows.select("doc_id", *first, base.alias("base_failed"), "kept", *more, "fail_bits")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(documents(spark, sf_dir), str(public_tokenizers.path(VOCABULARY)))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_knn.score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= quality_knn.SCORE_AT).cast("int"))


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic_segments.score(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", decontaminate.n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash_dedup.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op8_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(documents(spark, sf_dir), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_passages(documents(spark, sf_dir))
    ids = F.array_join(F.col("first_ids").cast("array<string>"), ",")
    return found.select("doc_id", "n_words", "n_repeated", "n_removed", _spans("spans").alias("spans"), _spans("removed").alias("removed"), ids.alias("first_ids"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(documents(spark, sf_dir)).select("doc_id", "lines_removed", "text")


QUERIES = {
    f.__name__: f
    for f in (
        op1_perspective_rotation, op2_quality_rules, op3_bpe, op4_quality_knn, op5_toxic_segments, op6_decontaminate, op7_simhash,
        op8_jump_sharding, op9_suffix_dedup, op10_line_dedup,
    )
}
ORACLE_SQL = oracles.SQL
