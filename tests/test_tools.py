"""Tools with a made-up runtime, and the readers and writers around them."""

from __future__ import annotations

import io
import json
import struct
import sys
import wave
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle

from lumenframe import tools
from lumenframe.operators import tensors
from lumenframe.sources import files


# Workers cannot import tests.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Runtime:
    """Results that follow from the content's first byte."""

    def face_detect(self, content):
        box = {"x": 1, "y": 2, "w": 30, "h": 40}
        return [{**box, "score": 0.6, "kps": None}, {**box, "score": 0.9, "kps": [[i, i * i] for i in range(5)]}]

    def face_vector(self, content, face):
        return np.arange(512)

    def object_detect(self, content):
        if content == b"bad":
            return [np.zeros((1, 4))] * 80
        slots = [np.zeros((0, 5))] * 80
        return [np.array([[0, 0, 50, 60, 0.5], [0, 0, 10, 60, 0.9], [0, 0, 50, 50, 0.1]]), *slots[1:]]

    def person_vector(self, content, box):
        return [3.0, 4.0]

    def depth(self, content):
        return np.arange(6.0).reshape(2, 3)

    def enhance(self, content):
        return np.full((4, 5, 3), 7)

    def ocr(self, content, mode):
        return {"text": f"read {mode}", "boxes": [(1, 2, 3, 4)]}

    def embed(self, content):
        return np.eye(512)[content[0] % 512]

    def text_embed(self, text, space):
        return np.eye(tools.DIMS[space])[len(text) % 3], len(text) > 20

    def transcribe(self, samples, language):
        assert len(samples) == 80_000
        return f" {language} {int(np.abs(samples).max() > 0)} "

    def vehicle_detect(self, content):
        raise RuntimeError("the device is gone")


def wav(seconds, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.sin(np.arange(int(seconds * rate))) * 20000).astype("<i2").tobytes())
    return out.getvalue()


def result(spark, tool, content=b"\x01", **parameters):
    kind = "string" if tool == "text_embed" else "binary"
    rows = spark.createDataFrame([(1, content)], f"video_id long, {'text' if kind == 'string' else 'content'} {kind}")
    return tools.apply_tool(rows, tool, Runtime, **parameters).first().asDict(recursive=True)


def test_tools(spark):
    assert [f["score"] for f in result(spark, "face_detect")["faces"]] == [0.6, 0.9]
    faces = result(spark, "face_embed", max_faces=2)["faces"]
    assert faces[0]["score"] == 0.9 and abs(np.linalg.norm(faces[0]["embedding"]) - 1) < 1e-9 and faces[1]["embedding"] is None and faces[1]["note"]
    found = result(spark, "object_detect")
    assert [(o["class_id"], o["w"], o["score"]) for o in found["objects"]] == [(0, 60, 0.9), (0, 60, 0.5)] and found["count"] == 2
    assert result(spark, "person_embed")["people"] == [{"class_id": 0, "x": 0, "y": 0, "w": 60, "h": 50, "score": 0.5, "embedding": [0.6, 0.8]}]
    depth = result(spark, "depth")
    assert (depth["min"], depth["max"], depth["mean"]) == (0, 5, 2.5)
    assert decoded(bytes(depth["png"])).tolist() == [[0, 51, 102], [153, 204, 255]]
    assert result(spark, "enhance_low_light")["width"] == 5
    assert result(spark, "ocr", mode="production") | {"error": None} == {"video_id": 1, "text": "read production", "char_count": 15, "boxes": [[1, 2, 3, 4]], "error_kind": None, "error": None}
    assert result(spark, "embed")["embedding"][1] == 1
    assert result(spark, "text_embed", "a cat", space="siglip2")["dim"] == 768
    shot = result(spark, "zero_shot", labels=["ab", "abc"], template="{}")
    assert shot["best"] == "ab" or [r["prob"] for r in shot["results"]] == sorted((r["prob"] for r in shot["results"]), reverse=True)
    heard = result(spark, "transcribe", wav(7), language="es")
    assert heard["chunks"] == 2 and heard["text"] == "es 1 es 1" and heard["duration_sec"] == 7


@pytest.mark.parametrize(("tool", "content", "kind"), [
    ("vehicle_detect", b"\x01", "device_error"), ("super_resolve", b"\x01", "not_implemented"), ("object_detect", b"bad", "device_error"), ("embed", None, "image_missing"), ("zero_shot", b"\x01", "invalid_input"),
])
def test_errors_stay_with_their_row(spark, tool, content, kind):
    found = result(spark, tool, content)
    assert found["error_kind"] == kind and found["error"]


def test_unknown_tools_and_modes(spark):
    with pytest.raises(ValueError):
        result(spark, "sing")
    with pytest.raises(ValueError):
        result(spark, "ocr", mode="slow")
    assert tools.status(Runtime())["tools"]["pose"] is False and tools.status(Runtime())["tools"]["depth"]


def decoded(content):
    """The grey pixels of a PNG."""
    assert content[:8] == b"\x89PNG\r\n\x1a\n"
    at, data, size = 8, b"", None
    while at < len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0]
        size = struct.unpack(">II", body[:8]) if kind == b"IHDR" else size
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(size[1], -1)[:, 1:]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.wav").write_bytes(wav(1))
    (tmp_path / "a" / "two.wav").write_bytes(b"RIFF no sound")
    heard = {r["video_id"]: r for r in files.audio_files(spark, str(tmp_path / "a")).collect()}
    assert len(heard["one"]["samples"]) == 16_000 and heard["one"]["channel"] == "a" and heard["two"]["samples"] is None and heard["two"]["error"]
    (tmp_path / "t").mkdir()
    half = np.array([[1.5, -2]], "<f2")
    head = json.dumps({"w": {"dtype": "F16", "shape": [1, 2], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "t" / "x.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + half.tobytes())
    found = files.tensor_files(spark, str(tmp_path / "t"), "w").first()
    assert (list(found["tensor"]), list(found["shape"])) == ([1.5, -2.0], [1, 2])
    assert files.tensor_files(spark, str(tmp_path / "t"), "other").first()["error"].startswith("KeyError")
    (tmp_path / "n").mkdir()
    np.savez(tmp_path / "n" / "y.npz", table=np.arange(4).reshape(2, 2))
    assert list(files.array_files(spark, str(tmp_path / "n"), "table").first()["tensor"]) == [0, 1, 2, 3]
    assert decoded(tensors.png(np.eye(3) * 255)).tolist() == (np.eye(3) * 255).tolist()
