"""A training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Stages take (spark, docs, sf_dir). All but the last return the columns of ``documents``, and any others that
``docs`` has, whatever their names; no stage reads more than the id and the text. ``ORACLE_SQL`` is None: SQL has no
SimHash nor byte-pair encoding; the tests run the pipeline against a brute-force version instead.

In every stage an empty table gives an empty one, and a text of any length is taken whole.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.lineage import ensure_checkpoint_dir, remove_folder
from lumenframe.llm import bpe, decontaminate, line_dedup, quality_rules, simhash_dedup
from lumenframe.llm.registry import VOCABULARY
from lumenframe.llm.words import documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality policy keeps, judged row by row: null and empty texts are rejected as too short,
    equal rows alike; ids are not looked at, so null and repeated ones make no difference."""
    return quality_rules.keep_documents(docs, "v1")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; all rows stay, and n_chars, where there is one, follows
    the text. Null and empty texts stay as they are; null ids come first in the order of occurrences; rows of equal id and
    text are one occurrence and change alike."""
    kept = line_dedup.dedup_documents(docs, count_col=None)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the one of the smallest id, null ids being last. Null and empty texts have the
    fingerprint zero and so are one group; of rows that share the id the text of the smallest hash stays, and one of equal rows."""
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the rule allows, judged row by row: null and empty texts are
    clean, equal rows alike; ids are not looked at."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each remaining text, and the digest of what they decode to; row by row, null and empty texts
    having none."""
    coded = bpe.encode(docs, str(public_tokenizers.path(VOCABULARY)))
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is a table in the shared checkpoint folder, which goes when the
    next one is whole. The last stays for its readers."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        if number:
            remove_folder(spark, f"{folder}/{number - 1}")
    return docs
