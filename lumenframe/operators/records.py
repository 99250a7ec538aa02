"""Prediction records: pruning, overlaying, defaults, fallbacks, counts, replay, and requests as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text
from lumenframe.lineage import materialised
from lumenframe.operators import entities

_NONE = "cast(array() as array<string>)"
#: What every record has where no tool has given anything, as SQL, in the order of the record.
NULL_BLOCK = {
    "ok": "false", "face_count": "0", "has_face": "false", "largest_face_area_ratio": "0.0D", "face_score_max": "0.0D", "ocr_text": "''", "ocr_text_corrected": "''",
    "ocr_char_count": "0", "ocr_block_count": "0", "ocr_has_year": "false", "ocr_has_digit": "false", "ocr_brands": _NONE, "ocr_brand_sources": "cast(map() as map<string,string>)",
    "ocr_models": _NONE, "ocr_years": "cast(array() as array<int>)", "ocr_years_ambiguous": "cast(array() as array<int>)", "ocr_brand_count": "0", "ocr_model_count": "0",
    **{f"ocr_keyword_{k}": _NONE for k in ("superlative", "freshness", "powertrain", "category", "review_format")},
    "clip_embedding": "cast(null as array<float>)", "vehicle_count": "0", "has_vehicle": "false", "largest_vehicle_area_ratio": "0.0D", "vehicle_score_max": "0.0D",
}
ERROR_KINDS = ("disabled", "weights_missing", "dependency_missing", "device_error", "not_implemented", "image_missing", "invalid_input")


def with_null_block(records: DataFrame, prefix: str = "vision_") -> DataFrame:
    """Records with all 28 features: those they lack, or have as null, take the block's value."""
    lower = {c.lower() for c in records.columns}
    filled = {
        prefix + k: F.coalesce(F.col(prefix + k), F.expr(v)) if (prefix + k).lower() in lower else F.expr(v) for k, v in NULL_BLOCK.items()
    }
    return records.withColumns(filled)


def pruned(records: DataFrame, prefix: str = "vision_", without: tuple[str, ...] = ("clip_embedding",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Only the columns of a prefix, but for those named, and ``keep`` before them."""
    gone = {prefix + w for w in without}
    return records.select(*keep, *[c for c in records.columns if c.startswith(prefix) and c not in gone])


def overlaid(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Records of ``left`` with the fields of ``right``: where both have a field, the right one stands, null or not; records without
    a partner stay as they are (P3)."""
    r = right.select(F.col(key).alias("_key"), F.struct(*[c for c in right.columns if c != key]).alias("_r"))
    both = left.join(r, F.col(key) == F.col("_key"), "left")
    met = F.col("_key").isNotNull()
    fields = [F.when(met, F.col("_r")[c]).otherwise(F.col(c)).alias(c) if c in right.columns and c != key else F.col(c) for c in left.columns]
    return both.select(*fields, *[F.col("_r")[c].alias(c) for c in right.columns if c not in left.columns])


def error_text(kind: Column, message: Column) -> Column:
    """``Type: message`` of a failed row, null of others."""
    return F.when(kind.isNotNull(), F.concat(kind, F.lit(": "), F.coalesce(message, F.lit(""))))


def outcome_counts(records: DataFrame, error: str, raw: str, corrected: str) -> DataFrame:
    """(n, n_errors, n_changed): rows, rows with an error, rows whose corrected text is another than the raw one."""
    changed = F.coalesce(F.col(corrected), F.lit("")) != F.coalesce(F.col(raw), F.lit(""))
    return records.agg(F.count("*").alias("n"), F.count_if(F.col(error).isNotNull()).alias("n_errors"), F.count_if(changed).alias("n_changed"))


def value_counts(rows: DataFrame, by: str, of: str) -> DataFrame:
    """(by, n, n_distinct): rows and distinct values of ``of`` for each value of ``by``."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(F.col(of)).alias("n_distinct"))


def replayed(records: DataFrame, dictionary: frozenset[str] | None, key: str = "video_id", raw: str = "ocr_text") -> DataFrame:
    """Corrected text and entities derived anew from the stored raw text (G3); the same every time it is run.

    (key, ocr_text, ocr_text_corrected, ocr_char_count, ocr_has_digit, ocr_has_year, ocr_brands, ocr_models, ocr_years,
    ocr_years_ambiguous, ocr_brand_count, ocr_model_count, ocr_keyword_*)
    """
    rows = records.select(key, text.first_filled(F.col(raw)).alias("ocr_text"))
    corrected = materialised(entities.corrected_text(rows, dictionary, key, "ocr_text").withColumnRenamed("corrected", "ocr_text_corrected"))
    found = entities.extract(corrected, key, "ocr_text_corrected")
    out = rows.join(corrected, key).join(found, key)
    return out.select(
        key, "ocr_text", "ocr_text_corrected", F.length("ocr_text").alias("ocr_char_count"), F.col("ocr_text").rlike(r"(?U)\d").alias("ocr_has_digit"),
        ((F.size("years") > 0) | (F.size("years_ambiguous") > 0)).alias("ocr_has_year"),
        *[F.col(c).alias(f"ocr_{c}") for c in ("brands", "models", "years", "years_ambiguous", "brand_count", "model_count")],
        *[F.col(f"keywords_{k}").alias(f"ocr_keyword_{k}") for k in lexicon.KEYWORDS],
    )


def answered(requests: DataFrame, tools: tuple[str, ...]) -> DataFrame:
    """(…, status, kind, message) of requests (method, path, body): which are well formed, and what is wrong with the others.

    A body is empty or a JSON object; anything else is a bad request.
    """
    path, body = F.col("path"), F.trim(F.coalesce("body", F.lit("")))
    name = F.substring(path, 5, 1000)
    parsed = F.try_parse_json(body)
    unknown_path = F.when(F.col("method") == "GET", path != "/health").otherwise(~F.startswith(path, F.lit("/v1/")))
    object_ = F.schema_of_variant(parsed).startswith("OBJECT")
    kind = (
        F.when(unknown_path, "unknown_path").when(F.col("method") == "GET", F.lit(None)).when(~name.isin(*tools), "unknown_tool")
        .when(body == "", F.lit(None)).when(parsed.isNull() | ~object_, "bad_request")
    )
    message = F.when(kind.isin("unknown_path", "unknown_tool"), path).when(parsed.isNull(), "body is not JSON").otherwise("body is not a JSON object")
    status = F.when(kind.isNull(), 200).when(kind == "bad_request", 400).otherwise(404)
    return requests.withColumns({"status": status, "kind": kind, "message": F.when(kind.isNotNull(), message)})


def nested(report: str, path: str, default: float = 0.0) -> Column:
    """A number inside a JSON text, ``default`` where any step is absent (2.15)."""
    return F.coalesce(F.get_json_object(F.col(report), path).try_cast("double"), F.lit(default))
