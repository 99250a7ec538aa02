"""The pixel query returns every value of the operator."""

from __future__ import annotations

import numpy as np

from lumenframe.operators import tensors
from lumenframe.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_all_pixel_features(spark):
    row = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").first()
    v = np.array(row["embedding"], np.float32)
    pixels = np.clip(np.outer(v, v) * 4000 + 128, 0, 255).astype(np.uint8)
    want = tensors.pixel_features(np.stack([pixels, pixels.T, 255 - pixels], axis=2))
    got = catalogue.QUERIES["image_pixel_stats"](spark, SMALL).filter(f"video_id = {row['vec_id']}").first().asDict()
    del got["video_id"]
    assert got == {k: float(x) for k, x in want.items()}
