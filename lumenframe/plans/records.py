"""Queries over prediction records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text
from lumenframe.operators import records
from lumenframe.plans import titles
from lumenframe.sources import tables
from lumenframe.sources.tables import TITLES_SQL

TOOLS = ("face_detect", "face_embed", "object_detect", "depth", "person_embed", "enhance_low_light", "ocr", "embed", "pose", "segment", "text_embed", "zero_shot", "transcribe")
ANCHORS = (7, 11)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles as prediction records: some failed, some features null."""
    t, k = tables.titles(spark, sf_dir), F.col("video_id")
    return t.select(
        "video_id", "title", F.when(k % 7 == 0, F.lit("ValueError")).alias("failed"), F.when(k % 3 != 0, F.substring("title", 1, 8)).alias("vision_ocr_text"),
        F.when(k % 4 != 1, (k % 5).cast("int")).alias("vision_face_count"), F.when(k % 2 == 0, F.array(F.lit(1.0).cast("float"))).alias("vision_clip_embedding"),
    )


def null_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with every feature, pruned to what is written."""
    found = records.pruned(records.with_null_block(_records(spark, sf_dir)), keep=("video_id",))
    return found.select(*[F.size(c).alias(c) if kind.startswith(("array", "map")) else F.col(c) for c, kind in found.dtypes])


def overlaid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles under their features; the features' own title, null for some, stands."""
    left = tables.titles(spark, sf_dir).withColumn("rank", F.lit(1))
    right = _records(spark, sf_dir).filter(F.col("video_id") % 5 != 0).select("video_id", F.when(F.col("video_id") % 2 == 0, F.upper("title")).alias("title"), "vision_face_count")
    return records.overlaid(left, right, "video_id")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, errors and changed texts (A15), errors being ``Type: message``."""
    r = _records(spark, sf_dir).withColumn("error", records.error_text(F.col("failed"), F.col("title")))
    r = r.withColumn("corrected", F.when(F.col("video_id") % 6 == 0, F.upper("vision_ocr_text")).otherwise(F.col("vision_ocr_text")))
    return records.outcome_counts(r, "error", "vision_ocr_text", "corrected")


def filled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of several texts that is neither null nor empty."""
    k = F.col("video_id")
    r = _records(spark, sf_dir).withColumn("corrected", F.when(k % 4 == 0, "").when(k % 4 != 2, F.lower("vision_ocr_text")))
    return r.select("video_id", text.first_filled(F.col("corrected"), F.col("vision_ocr_text")).alias("text"))


def anchor_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of stated ids."""
    return _records(spark, sf_dir).filter(F.col("video_id").isin(*ANCHORS)).select("video_id", "title", "failed")


def channel_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and distinct users of each kind of event."""
    return records.value_counts(tables.table(spark, sf_dir, "events"), "event_type", "user_id")


def replayed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected text and entities from the stored raw text, each list as text."""
    words = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w")).distinct()
    raw = titles._misread(spark, sf_dir).select("video_id", F.col("text").alias("ocr_text"))
    found = records.replayed(raw, frozenset(r["w"] for r in words.collect()))
    return found.select(*[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in found.dtypes])


def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as requests: paths, tools and bodies of all sorts (2.15)."""
    k = F.col("page_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))
    r = tables.table(spark, sf_dir, "pages").select(
        "page_id", pick(("POST", "POST", "POST", "GET"), k).alias("method"), pick(_PATHS, k).alias("path"), pick(_BODIES, k).alias("body")
    )
    return records.answered(r, TOOLS).select("page_id", "status", "kind", "message")


def nested_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of nested reports, some of them incomplete (2.15)."""
    k = F.col("page_id")
    report = F.when(k % 3 == 0, F.concat(F.lit('{"entity_scores": {"brand": {"f1": '), (k / 1000).cast("string"), F.lit("}}}"))).when(k % 3 == 1, '{"entity_scores": {}}').otherwise("{}")
    r = tables.table(spark, sf_dir, "pages").select("page_id", report.alias("report"))
    return r.select("page_id", records.nested("report", "$.entity_scores.brand.f1").alias("brand_f1"))


_PATHS = ("/v1/ocr", "/health", "/v1/nothing", "/v2/ocr", "/v1/pose")
_BODIES = ('{"image_path": "a"}', "", "[1]", "{broken", '"text"', "{}", "7")
_REC = f"""rec AS (SELECT video_id, title, CASE WHEN video_id % 7 = 0 THEN 'ValueError' END AS failed, CASE WHEN video_id % 3 <> 0 THEN title[:8] END AS ocr,
  CASE WHEN video_id % 4 <> 1 THEN (video_id % 5)::INT END AS faces FROM ({TITLES_SQL}))"""
_SIMPLE = {"0": "0", "false": "false", "0.0D": "0.0::DOUBLE", "''": "''"}
_GIVEN = {"ocr_text": "coalesce(ocr, '')", "face_count": "coalesce(faces, 0)"}
_BLOCK = ", ".join(f"{_GIVEN.get(k) or _SIMPLE.get(v, '0')} AS vision_{k}" for k, v in records.NULL_BLOCK.items() if k != "clip_embedding")

QUERIES = {
    f.__name__: f
    for f in (
        null_block, overlaid_records, outcome_counts, filled_texts, anchor_records, channel_value_counts, replayed_records, request_answers, nested_scores,
    )
}
ORACLE_SQL = {
    "replayed_records": rf"""WITH {titles._MIS}, e AS ({titles.entities_sql(titles.CORRECTED_SQL)})
      SELECT video_id, m.text AS ocr_text, c.text AS ocr_text_corrected, length(m.text) AS ocr_char_count, regexp_matches(m.text, '\p{{Nd}}') AS ocr_has_digit, years <> '' OR years_ambiguous <> '' AS ocr_has_year,
      {', '.join(f'{c} AS ocr_{c}' for c in ('brands', 'models', 'years', 'years_ambiguous', 'brand_count', 'model_count'))}, {', '.join(f'keywords_{k} AS ocr_keyword_{k}' for k in lexicon.KEYWORDS)}
      FROM m JOIN {titles.CORRECTED_SQL} c USING (video_id) JOIN e USING (video_id)""",
    "null_block": f"WITH {_REC} SELECT video_id, {_BLOCK} FROM rec",
    "overlaid_records": f"""WITH {_REC} SELECT video_id, CASE WHEN video_id % 5 = 0 THEN title WHEN video_id % 2 = 0 THEN upper(title) END AS title, 1 AS rank,
      CASE WHEN video_id % 5 <> 0 THEN faces END AS vision_face_count FROM rec""",
    "outcome_counts": f"WITH {_REC} SELECT count(*) AS n, count(failed) AS n_errors, count(*) FILTER (video_id % 6 = 0 AND upper(ocr) <> ocr) AS n_changed FROM rec",
    "filled_texts": f"WITH {_REC} SELECT video_id, coalesce(CASE WHEN video_id % 4 IN (1, 3) THEN nullif(lower(ocr), '') END, nullif(ocr, ''), '') AS text FROM rec",
    "anchor_records": f"WITH {_REC} SELECT video_id, title, failed FROM rec WHERE video_id IN {ANCHORS}",
    "channel_value_counts": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY event_type",
    "request_answers": f"""WITH r AS (SELECT page_id, (['POST', 'POST', 'POST', 'GET'])[page_id % 4 + 1] AS method, ({list(_PATHS)})[page_id % 5 + 1] AS path, ({list(_BODIES)})[page_id % 7 + 1] AS body FROM pages),
      k AS (SELECT *, CASE WHEN method = 'GET' THEN CASE WHEN path <> '/health' THEN 'unknown_path' END WHEN path NOT LIKE '/v1/%' THEN 'unknown_path' WHEN path = '/v1/nothing' THEN 'unknown_tool'
        WHEN body = '' THEN NULL WHEN NOT json_valid(body) THEN 'bad_request' WHEN json_type(body::JSON) <> 'OBJECT' THEN 'bad_request' END AS kind FROM r)
      SELECT page_id, CASE WHEN kind IS NULL THEN 200 WHEN kind = 'bad_request' THEN 400 ELSE 404 END AS status, kind,
        CASE WHEN kind IN ('unknown_path', 'unknown_tool') THEN path WHEN kind IS NOT NULL THEN CASE WHEN json_valid(body) THEN 'body is not a JSON object' ELSE 'body is not JSON' END END AS message FROM k""",
    "nested_scores": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN page_id / 1000 ELSE 0.0 END::DOUBLE AS brand_f1 FROM pages",
}
