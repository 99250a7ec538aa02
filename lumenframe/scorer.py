"""A place for models: rows in, features out, with failures kept to their row and tool.

No weights come with this library. A scorer is any object with some of the methods ``faces``,
``vehicles``, ``ocr`` and ``embed``, each taking the bytes of an image; it is made once per task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

MODES = ("fast", "production", "research")
#: What every row has where a tool is absent or fails.
EMPTY: dict[str, Any] = {
    "ok": False, "face_count": 0, "has_face": False, "largest_face_area_ratio": 0.0, "face_score_max": 0.0, "vehicle_count": 0,
    "has_vehicle": False, "largest_vehicle_area_ratio": 0.0, "vehicle_score_max": 0.0, "ocr_text": "", "ocr_block_count": 0,
    "clip_embedding": None, "error": None,
}
SCHEMA = (
    "ok boolean, face_count int, has_face boolean, largest_face_area_ratio double, face_score_max double, vehicle_count int, has_vehicle boolean, "
    "largest_vehicle_area_ratio double, vehicle_score_max double, ocr_text string, ocr_block_count int, clip_embedding array<float>, error string"
)


def check_mode(mode: str) -> str:
    """Raises before any work where the mode is unknown."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    return mode


def error_kind(error: BaseException) -> str:
    """A kind by the type of an exception, for a result's error struct."""
    kinds = ((FileNotFoundError, "image_missing"), (ImportError, "dependency_missing"), (NotImplementedError, "not_implemented"), (ValueError, "invalid_input"))
    return next((kind for t, kind in kinds if isinstance(error, t)), "device_error")


def scored_row(scorer: Any, content: bytes, pixels: int, mode: str) -> dict[str, Any]:
    """One image through all tools the scorer has; each may fail alone."""
    out, errors = dict(EMPTY), []

    def boxes(name: str, found: list[dict]) -> None:
        out[f"{name}_count"], out[f"has_{name}"] = len(found), bool(found)
        out[f"largest_{name}_area_ratio"] = round(max((b["w"] * b["h"] for b in found), default=0) / pixels, 5) if pixels else 0.0
        out[f"{name}_score_max"] = round(max((b["score"] for b in found), default=0.0), 4)

    def ocr(found: dict) -> None:
        out["ocr_text"], out["ocr_block_count"] = found["text"], len(found["boxes"])

    tools: list[tuple[str, Callable, Callable]] = [
        ("faces", lambda f: f(content), lambda r: boxes("face", r)), ("vehicles", lambda f: f(content), lambda r: boxes("vehicle", r)),
        ("ocr", lambda f: f(content, mode), ocr), ("embed", lambda f: f(content), lambda r: out.update(clip_embedding=list(r))),
    ]
    for name, call, keep in tools:
        if hasattr(scorer, name):
            try:
                keep(call(getattr(scorer, name)))
                out["ok"] = True
            except Exception as e:  # noqa: BLE001 - one tool's failure must not lose the others' results
                errors.append(f"{name}: {error_kind(e)}: {type(e).__name__}: {e}")
    out["error"] = "; ".join(errors) or None
    return out


def score(images: DataFrame, make: Callable[[], Any], mode: str = "production") -> DataFrame:
    """Images (video_id, content, pixels) with the features of a scorer made once per task."""
    check_mode(mode)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for part in parts:
            rows = [{"video_id": v, **scored_row(scorer, c, p, mode)} for v, c, p in zip(part["video_id"], part["content"], part["pixels"])]
            yield pd.DataFrame(rows, columns=["video_id", *EMPTY])

    kind = images.schema["video_id"].dataType.simpleString()
    return images.select("video_id", "content", "pixels").mapInPandas(run, f"video_id {kind}, {SCHEMA}")
