"""Boxes, sequences, sound, pixels and heads against values worked out by hand."""

from __future__ import annotations

import io
import json
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import scorer
from lumenframe.functions import boxes, sequences
from lumenframe.operators import evaluation, sampling, tensors

KIND = "array<struct<x:int,y:int,w:int,h:int>>"


def test_area_suppression(spark):
    df = spark.createDataFrame([([(0, 0, 100, 100), (10, 10, 90, 90), (200, 200, 50, 50)],)], f"b {KIND}")
    assert [tuple(b) for b in df.select(boxes.by_area(F.col("b"), KIND)).first()[0]] == [(0, 0, 100, 100), (200, 200, 50, 50)]


def test_unclip(spark):
    grown = boxes.unclipped(*(F.lit(v) for v in (10, 10, 50, 20, 100, 100)))
    assert tuple(spark.range(1).select(*[c.alias(n) for n, c in grown.items()]).first()) == (4, 8, 62, 24)


def test_ctc(spark):
    df = spark.createDataFrame([([1, 1, 0, 1, 2, 2, 0, 3],)], "l array<int>")
    assert df.select(sequences.ctc_text(F.col("l"), "abc")).first()[0] == "aabc"


def test_repetition_penalty(spark):
    df = spark.createDataFrame([([2.0] * 60, [7, 11, 13, 42]), ([2.0] * 60, [5] + [20] * 8)], "l array<double>, g array<int>")
    a, b = (r[0] for r in df.select(sequences.penalised(F.col("l"), F.col("g"), 2.0, 8, exempt=(11, 13))).collect())
    assert (a[7], a[42], a[11], a[13], a[50]) == (1.0, 1.0, 2.0, 2.0, 2.0) and (b[5], b[20]) == (2.0, 1.0)


def test_busy_time(spark):
    df = spark.createDataFrame([("a", 0, 30), ("a", 10, 50), ("a", 100, 120), ("b", 0, None)], "key string, start_ms long, end_ms long")
    for slot in (86_400_000, 7):
        got = {r["key"]: (r["busy_ms"], r["summed_ms"]) for r in sampling.busy_time(df, F.lit(250), slot_ms=slot).collect()}
        assert got == {"a": (70, 90), "b": (250, 250)}


def heads(extra, channels):
    out = []
    for stride in tensors.STRIDES:
        g = 640 // stride
        out += [np.zeros((1, g, g, 64)), np.zeros((1, g, g, 1)), np.zeros((1, g, g, channels))]
    out[0][0, 10, 20].reshape(4, 16)[:, 4] = 50
    return out + extra


def test_pose():
    t = heads([], 51)
    t[1][0, 10, 20, 0] = 0.9
    t[2][0, 10, 20] = 0.75
    got = tensors.pose(t)
    assert np.allclose(got["boxes"], [[132, 52, 196, 116]]) and np.allclose(got["keypoints"][0, 0], [172, 92]) and not got["sigmoid"]
    t[1][0, 10, 20, 0] = 0.1
    assert len(tensors.pose(t)["boxes"]) == 0
    for i in (1, 4, 7):
        t[i][:] = -10
    t[1][0, 10, 20, 0] = 4
    assert tensors.pose(t)["sigmoid"] and tensors.pose(t)["scores"][0] == pytest.approx(1 / (1 + np.exp(-4)))
    with pytest.raises(ValueError, match="coeff"):
        tensors.masks([*t, np.zeros((1, 160, 160, 32))], 1)
    with pytest.raises(ValueError, match="missing"):
        tensors.pose(t[:3])


def test_masks():
    t = heads([np.zeros((1, 160, 160, 32))], 32)
    t = [np.zeros((1, x.shape[1], x.shape[1], 5)) if x.shape[3] == 1 else x for x in t]
    t[1][0, 10, 20, 3] = 0.9
    t[2][0, 10, 20, 0] = 1
    t[-1][0, :, :, 0] = 9
    got = tensors.masks(t, 5)
    assert got["classes"].tolist() == [3] and got["masks"][0, 84, 164] and not got["masks"][0, 300, 300]
    assert abs(got["masks"][0].sum() / 64**2 - 1) < 0.15
    assert (tensors.painted(got["masks"], got["scores"]) == got["masks"][0]).all()


def test_log_mel():
    x, filters = np.random.default_rng(7).standard_normal(8000) * 0.1, np.random.default_rng(1).random((80, 201))
    got = tensors.log_mel(x, filters)
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400)
    padded = np.concatenate([x[200:0:-1], x, x[-2:-202:-1]])
    basis = np.exp(-2j * np.pi * np.outer(np.arange(201), np.arange(400)) / 400)
    power = np.stack([np.abs(basis @ (padded[160 * i : 160 * i + 400] * hann)) ** 2 for i in range(50)], axis=1)
    logs = np.log10(np.maximum(filters @ power, 1e-10))
    assert got.shape == (80, 50) and got.dtype == np.float32
    assert np.allclose(got, (np.maximum(logs, logs.max() - 8) + 4) / 4, atol=1e-4)


def test_wav_and_safetensors():
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.repeat(np.arange(100, dtype="<i2"), 2).tobytes())
    got = tensors.wav_samples(raw.getvalue())
    assert len(got) == 200 and got[-1] == pytest.approx(99 / 32768)
    head = json.dumps({"t": {"dtype": "BF16", "shape": [1, 2], "data_offsets": [0, 4]}}).encode()
    content = struct.pack("<Q", len(head)) + head + np.array([0x3F80, 0x4000], "<u2").tobytes()
    assert tensors.safetensor(content, "t").tolist() == [[1.0, 2.0]]


def test_pixels():
    image = np.zeros((30, 30, 3), np.uint8)
    image[:, 15:] = (0, 0, 255)
    got = tensors.pixel_features(image)
    assert got["unique_color_ratio"] == round(2 / 900, 6) and got["saturation_high_ratio"] == 0.5 and got["warm_color_ratio"] == 1.0
    assert got["edge_density"] == pytest.approx(1 / 30, abs=0.04) and got["aspect_ratio"] == 1.0
    h, s, v = tensors.hsv(np.array([[[255, 0, 0], [0, 255, 0], [10, 10, 10]]], np.uint8))
    assert h.tolist() == [[120, 60, 0]] and s.tolist() == [[255, 255, 0]] and v.tolist() == [[255, 255, 10]]


def test_faces_tiles_and_alignment():
    scores, far = np.zeros((4, 4, 2)), np.ones((4, 4, 8))
    scores[1, 2, 0] = 0.9
    got = tensors.faces(scores, far, None, 8)
    assert len(got) == 1 and got[0]["box"].tolist() == [12, 4, 28, 20]
    assert np.allclose(tensors.blended([(0, 0, np.ones((8, 8))), (0, 4, np.ones((8, 8)))], 8, 12, 4)[2:6, 2:10], 1)
    face = np.array([[38, 52], [74, 52], [56, 72], [42, 92], [71, 92]], float)
    turn = np.array([[0, -1], [1, 0]])
    assert tensors.alignment_error(2 * face @ turn.T + 5, face) is None
    assert tensors.alignment_error(np.outer(np.arange(5), [30, 30]), face) == "landmarks do not fit"
    assert tensors.alignment_error(face / 10, face) == "landmarks too small"


def test_error_rates_and_grid(spark):
    df = spark.createDataFrame([("a b c", "a x c"), ("día", "dia"), (" ", "zz"), (None, "q")], "truth string, predicted string")
    got = {r["mode"]: (r["n"], r["cer"], r["wer"]) for r in evaluation.error_rates(df).collect()}
    assert got == {"strict": (2, 0.25, 0.5), "lenient": (2, 0.125, 0.25)}
    grid = evaluation.grid(spark, (0.3, 0.5), (0.5, 1.0)).selectExpr("*", "0.5747D AS brand_f1", "0.9302D AS year_f1", "0.5619D AS cer")
    assert evaluation.ranked_grid(grid).first()["tag"] == "a0.3_b0.5"


@pytest.mark.parametrize(
    ("counts", "want"), [((25, 0, 37), (1.0, 0.4032, 0.5747)), ((18, 9, 10), (0.6667, 0.6429, 0.6545)), ((0, 0, 1), (0.0, 0.0, 0.0)), ((20, 0, 3), (1.0, 0.8696, 0.9302))]
)
def test_prf(spark, counts, want):
    assert tuple(spark.range(1).select(*evaluation.prf(*map(F.lit, counts))).first()) == want


def test_p_values():
    assert evaluation.spearman_p(0.0, 30) == pytest.approx(1.0)
    assert evaluation.spearman_p(0.5, 10) == pytest.approx(0.1411, abs=1e-3)
    assert evaluation.spearman_p(-1.0, 10) == 0.0


def test_stratified(spark):
    df = spark.createDataFrame([(c, i) for c in "abc" for i in range(12)], "channel string, video_id int")
    got = sampling.stratified(df, F.col("channel") == "a", 10)
    assert {r["channel"]: r["count"] for r in got.groupBy("channel").count().collect()} == {"a": 12, "b": 10, "c": 10}
    with pytest.raises(ValueError, match="only 12"):
        sampling.stratified(df, F.col("channel") == "a", 13)


def test_scorer(spark):
    class Half:
        def faces(self, content):
            return [{"w": 10, "h": 5, "score": 0.75}]

        def ocr(self, content, mode):
            raise ValueError("no text")

    df = spark.createDataFrame([(1, bytearray(b"x"), 1000)], "video_id long, content binary, pixels long")
    r = scorer.score(df, Half).first()
    assert r["ok"] and r["face_count"] == 1 and r["largest_face_area_ratio"] == 0.05 and r["vehicle_count"] == 0 and "ocr: invalid_input" in r["error"]
    with pytest.raises(ValueError, match="mode"):
        scorer.score(df, Half, "slow")
