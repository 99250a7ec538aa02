"""The calibration's rank correlation takes every pair of rows, between channels too, in blocks of any size."""

from __future__ import annotations

import numpy as np

from lumenframe.operators import similarity
from lumenframe.plans import catalogue
from lumenframe.sources import tables

SMALL = "/root/testdata/sf0.001"


def ranks(v):
    order, out = np.argsort(v), np.empty(len(v))
    values, start = v[order], 0
    for end in range(1, len(v) + 1):
        if end == len(v) or values[end] != values[start]:
            out[order[start:end]] = (start + end + 1) / 2
            start = end
    return out


def test_all_pairs(spark):
    rows = [np.array([r["embedding"] for r in f(spark, SMALL).orderBy("video_id").collect()], float) for f in (tables.embeddings, tables.quantised)]
    n = len(rows[0])
    upper = np.triu_indices(n, 1)
    a, b = (ranks(np.round(((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T)[upper], 9)) for x in rows)
    found = similarity.pairwise_spearman(tables.embeddings(spark, SMALL), tables.quantised(spark, SMALL), block=64).first()
    assert found["n_pairs"] == n * (n - 1) // 2 and abs(found["rho"] - np.corrcoef(a, b)[0, 1]) < 1e-6
    whole = catalogue.QUERIES["calibration_pairwise_spearman"](spark, SMALL).first()
    assert whole["n_pairs"] == found["n_pairs"] and abs(whole["rho"] - found["rho"]) < 1e-6


def exact(rows):
    upper = np.triu_indices(len(rows[0]), 1)
    units = [x / np.linalg.norm(x, axis=1, keepdims=True) for x in rows]
    return np.corrcoef(*(ranks(np.round((x @ x.T)[upper], 9)) for x in units))[0, 1]


def kept_pairs(*_):
    raise AssertionError("pairs are kept as rows")


def test_pairs_are_not_kept(spark, monkeypatch):
    monkeypatch.setattr(similarity, "spearman", kept_pairs)
    monkeypatch.setattr(similarity, "SORTED", 0, raising=False)
    rows = [np.array([r["embedding"] for r in f(spark, SMALL).orderBy("video_id").collect()], float) for f in (tables.embeddings, tables.quantised)]
    n = len(rows[0])
    found = similarity.pairwise_spearman(tables.embeddings(spark, SMALL), tables.quantised(spark, SMALL)).first()
    assert found["n_pairs"] == n * (n - 1) // 2 and round(found["rho"], 6) == round(exact(rows), 6)


def test_ties_of_copies(spark, monkeypatch):
    """A third are copies, and the second model is a poor one: only levels counted by cell tell all digits."""
    monkeypatch.setattr(similarity, "spearman", kept_pairs)
    monkeypatch.setattr(similarity, "SORTED", 0, raising=False)
    draw = np.random.default_rng(3)
    a = draw.standard_normal((240, 8))
    a[:80] = a[0]
    b = a + draw.standard_normal((240, 8))
    b[:80] = b[0]
    a, b = ([(0, i, [float(x) for x in row]) for i, row in enumerate(rows)] for rows in (a, b))
    left, right = (spark.createDataFrame(x, "channel int, video_id long, embedding array<double>") for x in (a, b))
    found = similarity.pairwise_spearman(left, right).first()
    assert found["n_pairs"] == 240 * 239 // 2
    assert round(found["rho"], 6) == round(exact([np.array([r[2] for r in x]) for x in (a, b)]), 6)
