"""The model tools as table functions: inputs as rows in, results or a structured error out.

No weights come with this library. A runtime is any object with some of the methods named in ``TOOLS``; it is made once per
task. What a tool does around its model (ordering, thresholds, contracts, normalisation, pictures) is done here, so that
any runtime gives the same results. A tool that fails, or that the runtime lacks, gives a row with an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenframe.operators import tensors
from lumenframe.scorer import check_mode, error_kind

BOX = "x: int, y: int, w: int, h: int, score: double"
#: Classes of the object detector, and the side of a person that is too small to tell.
CLASSES, LEAST_PERSON = 80, 20
DIMS = {"tinyclip": 512, "siglip2": 768}
NO_RESULT = "unsupported: this runtime lacks the tool"


def _unit(v: Any) -> list[float]:
    v = np.asarray(v, float)
    return (v / (np.linalg.norm(v) or 1.0)).tolist()


def _strongest(found: list[dict]) -> list[dict]:
    return sorted(found, key=lambda b: -b["score"])


def _face_detect(r: Any, row: dict, p: dict) -> dict:
    faces = r.face_detect(row["content"])
    return {"faces": faces, "count": len(faces)}


def _face_embed(r: Any, row: dict, p: dict) -> dict:
    """The strongest faces with a unit vector each (M2, W7); one without five fitting landmarks has a note instead."""
    out = []
    for f in _strongest(r.face_detect(row["content"]))[: p.get("max_faces", 16)]:
        if not f.get("kps"):
            out.append({**f, "embedding": None, "note": "no landmarks from the detector; cannot align"})
            continue
        if why := tensors.alignment_error(np.array(f["kps"], float), np.array(p["template"], float)) if "template" in p else None:
            raise ValueError(why)
        out.append({**f, "embedding": _unit(r.face_vector(row["content"], f)), "note": None})
    return {"faces": out, "count": len(out)}


def _object_detect(r: Any, row: dict, p: dict) -> dict:
    """Boxes that reach the score, highest first (M3). The model must give a list of finite (n, 5) arrays, one per class."""
    slots = r.object_detect(row["content"])
    if len(slots) != CLASSES or any(np.ndim(s) != 2 or np.shape(s)[1] != 5 for s in slots if len(s)):
        raise RuntimeError("object tensor does not fit its contract")
    found = []
    for kind, rows in enumerate(slots):
        for y1, x1, y2, x2, score in np.asarray(rows, float).reshape(-1, 5):
            if not np.isfinite([y1, x1, y2, x2, score]).all():
                raise RuntimeError("object tensor is not finite")
            if score >= p.get("score_threshold", 0.3):
                found.append({"class_id": kind, "x": int(x1), "y": int(y1), "w": int(x2 - x1), "h": int(y2 - y1), "score": round(score, 4)})
    return {"objects": _strongest(found), "count": len(found)}


def _person_embed(r: Any, row: dict, p: dict) -> dict:
    """People that are large enough, with a unit vector each (M4)."""
    people = [b for b in _object_detect(r, row, p)["objects"] if b["class_id"] == 0 and min(b["w"], b["h"]) >= LEAST_PERSON]
    return {"people": [{**b, "embedding": _unit(r.person_vector(row["content"], b))} for b in people], "count": len(people)}


def _depth(r: Any, row: dict, p: dict) -> dict:
    d = np.asarray(r.depth(row["content"]), float)
    return {"png": tensors.png(tensors.grey_levels(d)), "min": float(d.min()), "max": float(d.max()), "mean": float(d.mean())}


def _picture(method: str) -> Callable:
    def run(r: Any, row: dict, p: dict) -> dict:
        image = np.asarray(getattr(r, method)(row["content"]))
        return {"png": tensors.png(image), "width": int(image.shape[1]), "height": int(image.shape[0])}

    return run


def _ocr(r: Any, row: dict, p: dict) -> dict:
    found = r.ocr(row["content"], p["mode"])
    return {"text": found["text"], "char_count": len(found["text"]), "boxes": [list(map(int, b)) for b in found["boxes"]]}


def _embed(method: str, dim: int) -> Callable:
    def run(r: Any, row: dict, p: dict) -> dict:
        v = _unit(getattr(r, method)(row["content"]))
        if len(v) != dim:
            raise RuntimeError(f"embedding has {len(v)} numbers, not {dim}")
        return {"embedding": v, "dim": len(v)}

    return run


def _pose(r: Any, row: dict, p: dict) -> dict:
    """People with 17 joints each, decoded from the raw heads."""
    d = tensors.pose(r.pose(row["content"]), score_over=p.get("score_threshold", 0.3))
    people = [
        {"x": int(b[0]), "y": int(b[1]), "w": int(b[2] - b[0]), "h": int(b[3] - b[1]), "score": round(float(s), 4), "keypoints": [[*map(float, q), float(c)] for q, c in zip(k, j)]}
        for b, s, k, j in zip(d["boxes"], d["scores"], d["keypoints"], d["joint_scores"])
    ]
    return {"people": people, "count": len(people), "scores_sigmoid_applied": bool(d["sigmoid"])}


def _segment(r: Any, row: dict, p: dict) -> dict:
    """Instances and a picture of their numbers, the strongest on top (M10, N15, N16); of one class where ``everything`` is asked for."""
    d = tensors.masks(r.segment(row["content"], bool(p.get("everything"))), 1 if p.get("everything") else CLASSES, score_over=p.get("score_threshold", 0.25))
    if len(d["scores"]) > 255:
        raise RuntimeError("more instances than ids")
    found = [
        {"class_id": int(c), "x": int(b[0]), "y": int(b[1]), "w": int(b[2] - b[0]), "h": int(b[3] - b[1]), "score": round(float(s), 4)} for b, s, c in zip(d["boxes"], d["scores"], d["classes"])
    ]
    return {"instances": found, "png": tensors.png(tensors.painted(d["masks"], d["scores"])), "count": len(found), "scores_sigmoid_applied": bool(d["sigmoid"])}


def _text_embed(r: Any, row: dict, p: dict) -> dict:
    space = p.get("space", "tinyclip")
    if space not in DIMS:
        raise ValueError(f"space must be one of {tuple(DIMS)}")
    v, truncated = r.text_embed(row["text"], space)
    if len(v) != DIMS[space]:
        raise RuntimeError(f"embedding has {len(v)} numbers, not {DIMS[space]}")
    return {"embedding": _unit(v), "dim": len(v), "space": space, "truncated": bool(truncated)}


def _zero_shot(r: Any, row: dict, p: dict) -> dict:
    """Labels by their probability, a softmax of cosines at a temperature of 0.01."""
    if not p.get("labels"):
        raise ValueError("labels must not be empty")
    image = np.array(_unit(r.embed(row["content"])))
    sims = np.array([image @ _unit(r.text_embed(p.get("template", "a photo of a {}").format(x), p.get("space", "tinyclip"))[0]) for x in p["labels"]])
    odds = np.exp((sims - sims.max()) / 0.01)
    ranked = sorted(({"label": x, "similarity": round(float(s), 4), "prob": round(float(q), 5)} for x, s, q in zip(p["labels"], sims, odds / odds.sum())), key=lambda x: -x["prob"])
    return {"results": ranked, "best": ranked[0]["label"]}


def _transcribe(r: Any, row: dict, p: dict) -> dict:
    """Chunks of five seconds, sixty at most, each padded, and their texts joined."""
    rate, seconds = 16_000, 5
    samples = tensors.wav_samples(row["content"], rate)[: 60 * rate]
    pieces = [samples[i : i + seconds * rate] for i in range(0, len(samples), seconds * rate)]
    texts = [r.transcribe(np.pad(x, (0, seconds * rate - len(x))), p.get("language", "en")).strip() for x in pieces]
    return {"text": " ".join(t for t in texts if t), "chunks": len(pieces), "language": p.get("language", "en"), "duration_sec": round(len(samples) / rate, 2)}


@dataclass(frozen=True)
class Tool:
    """``needs`` names the runtime's methods, ``schema`` the result's fields, ``run`` what is done around them."""

    needs: tuple[str, ...]
    schema: str
    run: Callable[[Any, dict, dict], dict]


_KPS = "kps: array<array<double>>"
TOOLS = {
    "face_detect": Tool(("face_detect",), f"faces array<struct<{BOX}, {_KPS}>>, count int", _face_detect),
    "face_embed": Tool(("face_detect", "face_vector"), f"faces array<struct<{BOX}, {_KPS}, embedding: array<double>, note: string>>, count int", _face_embed),
    "object_detect": Tool(("object_detect",), f"objects array<struct<class_id: int, {BOX}>>, count int", _object_detect),
    "person_embed": Tool(("object_detect", "person_vector"), f"people array<struct<class_id: int, {BOX}, embedding: array<double>>>, count int", _person_embed),
    "depth": Tool(("depth",), "png binary, min double, max double, mean double", _depth),
    "enhance_low_light": Tool(("enhance",), "png binary, width int, height int", _picture("enhance")),
    "super_resolve": Tool(("super_resolve",), "png binary, width int, height int", _picture("super_resolve")),
    "ocr": Tool(("ocr",), "text string, char_count int, boxes array<array<int>>", _ocr),
    "embed": Tool(("embed",), "embedding array<double>, dim int", _embed("embed", 512)),
    "reference_embed": Tool(("reference_embed",), "embedding array<double>, dim int", _embed("reference_embed", 512)),
    "pose": Tool(("pose",), f"people array<struct<{BOX}, keypoints: array<array<double>>>>, count int, scores_sigmoid_applied boolean", _pose),
    "segment": Tool(("segment",), f"instances array<struct<class_id: int, {BOX}>>, png binary, count int, scores_sigmoid_applied boolean", _segment),
    "text_embed": Tool(("text_embed",), "embedding array<double>, dim int, space string, truncated boolean", _text_embed),
    "zero_shot": Tool(("embed", "text_embed"), "results array<struct<label: string, similarity: double, prob: double>>, best string", _zero_shot),
    "transcribe": Tool(("transcribe",), "text string, chunks int, language string, duration_sec double", _transcribe),
    "vehicle_detect": Tool(("vehicle_detect",), f"vehicles array<struct<{BOX}>>, count int", lambda r, row, p: (lambda v: {"vehicles": _strongest(v), "count": len(v)})(r.vehicle_detect(row["content"]))),
}


def apply_tool(rows: DataFrame, tool: str, make: Callable[[], Any], key: str = "video_id", **parameters: Any) -> DataFrame:
    """(key, the tool's result, error_kind, error): one row per row of ``rows`` (key, content; for text_embed key, text)."""
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool!r}")
    if tool == "ocr":
        parameters["mode"] = check_mode(parameters.get("mode", "fast"))
    spec, source = TOOLS[tool], "text" if tool == "text_embed" else "content"
    names = [part.strip().split(" ")[0] for part in _fields(spec.schema)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runtime = make()
        lacking = not all(hasattr(runtime, m) for m in spec.needs)
        for part in parts:
            out = []
            for name, value in zip(part[key], part[source]):
                row: dict[str, Any] = dict.fromkeys(names) | {key: name, "error_kind": None, "error": None}
                try:
                    if lacking:
                        raise NotImplementedError(NO_RESULT)
                    if value is None:
                        raise FileNotFoundError("no input")
                    row |= spec.run(runtime, {source: bytes(value) if source == "content" else value}, parameters)
                except Exception as e:  # noqa: BLE001 - one row's failure must not lose the others'
                    row |= {"error_kind": error_kind(e), "error": f"{type(e).__name__}: {e}"}
                out.append(row)
            yield pd.DataFrame(out, columns=[key, *names, "error_kind", "error"], dtype=object)

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, source).mapInPandas(run, f"{key} {kind}, {spec.schema}, error_kind string, error string")


def _fields(schema: str) -> list[str]:
    """A schema's fields, cut at the commas that stand in no type."""
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [*out, part]


def status(runtime: Any) -> dict[str, Any]:
    """Which tools a runtime can run (M14); asks it nothing else."""
    return {"tools": {name: all(hasattr(runtime, m) for m in t.needs) for name, t in TOOLS.items()}}
