"""What the Python steps of suffix dedup hold is bounded by bytes, cells and masks, and the bounds change no result."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from lumenframe.llm import suffix_dedup

MB = 1 << 20
WORDS = [f"word{i * 7919 % 100_003}" for i in range(3000)]
LONG, INT = T.LongType(), T.IntegerType()
INNER = T.StructType([T.StructField(n, t) for n, t in (("g", LONG), ("c", LONG), ("n", LONG), ("lowest", LONG), ("at", INT), ("first", INT), ("size", INT))])


class Rows:
    """Stands for a table: gives back the function that would run over its batches."""

    def __init__(self, **columns: T.DataType):
        self.schema = T.StructType([T.StructField(n, t) for n, t in columns.items()])

    def select(self, *_):
        return self

    def mapInArrow(self, run, _schema):
        return run


def texts(count: int, words: int) -> list[str]:
    return [" ".join(random.Random(k).choices(WORDS, k=words)) for k in range(count)]


def kept(made: list[str | None]):
    run = suffix_dedup._kept_suffixes(Rows(doc_id=LONG, t1=LONG, text=T.StringType()), 50, 16)
    return run, pa.RecordBatch.from_arrays([pa.array(range(len(made))), pa.array(range(len(made))), pa.array(made, pa.string())], names=["doc_id", "t1", "text"])


def contexts(made: list[str]):
    run = suffix_dedup._contexts(Rows(text=T.StringType(), cells=T.ArrayType(INNER)), 50)
    found = [suffix_dedup.cells(suffix_dedup.word_hashes(t), 50, 16) for t in made]
    ends = np.concatenate(([0], np.cumsum([len(x[0]) for x in found]))).astype(np.int32)
    g, c, at, first, last = (np.concatenate(x) for x in zip(*found))
    one = np.ones(len(g), np.int64)
    columns = [g.view(np.int64), c.view(np.int64), one, one, *(x.astype(np.int32) for x in (at, first, last - first + 1))]
    structs = pa.StructArray.from_arrays([pa.array(x) for x in columns], names=INNER.names)
    return run, pa.RecordBatch.from_arrays([pa.array(made), pa.ListArray.from_arrays(ends, structs)], names=["text", "cells"])


def merged(docs: int, cells: int, masks: int):
    run = suffix_dedup._merged(Rows(doc_id=LONG, n_words=INT, found=T.ArrayType(INNER)), 50)
    n = docs * cells * masks
    held = pa.StructArray.from_arrays([pa.array(np.arange(n) % 97), pa.array(np.int64(1) << (np.arange(n) % masks))], names=["lowest", "mask"])
    lists = pa.ListArray.from_arrays(np.arange(0, n + 1, masks, dtype=np.int32), held)
    found = pa.StructArray.from_arrays([pa.array((np.arange(docs * cells) % cells * 60).astype(np.int32)), pa.array(np.zeros(docs * cells, np.int64)), lists], names=["first", "again", "masks"])
    column = pa.ListArray.from_arrays(np.arange(0, docs * cells + 1, cells, dtype=np.int32), found)
    return run, pa.RecordBatch.from_arrays([pa.array(range(docs)), pa.array(np.full(docs, 9, np.int32)), column], names=["doc_id", "n_words", "found"])


def peak_mb(run, batch: pa.RecordBatch) -> tuple[float, float]:
    """MB that a step takes beyond its batch: at most, and still when it is done."""
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return most / MB, now / MB


@pytest.mark.parametrize(("step", "most"), [(lambda: kept(texts(100, 20_000)), 16), (lambda: contexts(texts(3000, 500)), 30), (lambda: merged(500, 200, 20), 30)], ids=["kept", "contexts", "merged"])
def test_rows_of_a_batch_do_not_add_up(step, most):
    run, batch = step()
    peak, _ = peak_mb(run, batch)
    assert peak < most, f"{peak:.0f} MB for a batch of {batch.nbytes / MB:.0f} MB"


def test_one_long_text_leaves_nothing_behind():
    run, batch = kept([" ".join(WORDS * 150)])
    peak, after = peak_mb(run, batch)
    assert after < 4 and peak < 100, f"{peak:.0f} MB, then {after:.0f} MB for a text of {batch.nbytes / MB:.0f} MB"


def told(run, batch: pa.RecordBatch) -> list[dict]:
    # Empty batches and one that is part of another come as well.
    return [r for b in run(iter([batch.slice(0, 0), batch, batch.slice(2, 3)])) for r in b.to_pylist()]


@pytest.mark.parametrize(("text_bytes", "powers", "documents", "masks"), [(1, 0, 1, 1), (5000, 100, 3, 9), (1 << 22, 1 << 16, 512, 1 << 17)])
def test_bounds_change_no_result(monkeypatch, text_bytes, powers, documents, masks):
    repeated = " ".join(WORDS[:60])
    made = [*texts(9, 300), f"{repeated} between {repeated}", *texts(2, 49), " \t\n ", "", *texts(1, 5000)]
    steps = [kept([None, *made, None]), contexts([t for t in made if len(t.split()) > 49]), merged(11, 5, 4)]
    want = [told(*s) for s in steps]
    for name, value in (("TEXT_BYTES", text_bytes), ("MOST_POWERS", powers), ("DOCUMENTS", documents), ("MASKS", masks)):
        monkeypatch.setattr(suffix_dedup, name, value)
    assert [told(*s) for s in steps] == want and all(want)


def test_slices():
    draw = random.Random(3)
    for _ in range(200):
        weights = np.array([draw.choice((0, 1, 5, 40)) for _ in range(draw.randrange(30))], np.int64)
        rows = draw.choice((None, 1, 4))
        found = list(suffix_dedup._slices(weights, 20, rows))
        assert [i for a, b in found for i in range(a, b)] == list(range(len(weights)))
        assert all(b - a == 1 or weights[a:b].sum() <= 20 and b - a <= (rows or b) for a, b in found)
