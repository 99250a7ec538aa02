"""first_ids of repeated passages against brute force, where copies stand around a shared passage."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from brute import space_words

from lumenframe.llm import suffix_dedup


def firsts(docs, size):
    """doc_id to the smallest ids that hold its repeated windows; docs are (doc_id, text)."""
    spots = defaultdict(list)
    for d, t in docs:
        words = space_words(t)
        for i in range(len(words) - size + 1):
            spots[tuple(words[i : i + size])].append(d)
    out = defaultdict(set)
    for where in spots.values():
        if len(where) > 1:
            for d in where:
                out[d].add(min(where))
    return {d: sorted(x) for d, x in out.items()}


def around_passages(seed, size):
    """Texts of their own and copied ones around passages of one to two windows, which other texts hold too."""
    draw = random.Random(seed)
    fresh = lambda n: " ".join(f"w{draw.getrandbits(40)}" for _ in range(n))
    texts = []
    for _ in range(8):
        passage = fresh(draw.randrange(size, 2 * size))
        texts += [f"{fresh(draw.randrange(size))} {passage} {fresh(draw.randrange(size))}" for _ in range(draw.randrange(1, 4))]
        for _ in range(draw.randrange(1, 3)):
            texts += [f"{fresh(draw.randrange(2 * size))} {passage} {fresh(draw.randrange(2 * size))}"] * draw.randrange(1, 5)
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("size", "gram", "seed"), [(50, 16, 1), (50, 16, 2), (6, 3, 3)])
def test_first_ids(spark, size, gram, seed):
    rows = around_passages(seed, size)
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), min_words=size, gram=gram).collect()
    assert {r["doc_id"]: list(r["first_ids"]) for r in found} == firsts(rows, size)


def test_first_ids_of_copies_that_share_a_passage(spark):
    passage = " ".join(f"p{i}" for i in range(55))
    copy = " ".join(f"a{i}" for i in range(90)) + f" {passage} " + " ".join(f"z{i}" for i in range(90))
    rows = [(1, "other words " + passage + " end"), *[(d, copy) for d in range(5, 10)]]
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {r["doc_id"]: list(r["first_ids"]) for r in found}
    assert got == firsts(rows, 50) and got[6] == [1, 5]


def test_row_repeated_often(spark):
    """One text under a null id, many times over: its cells come once, and the copy of the smallest id stays."""
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(1, text), (2, f"{text} tail"), *[(None, text)] * 600]
    found = suffix_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    members = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_repeated"], r["n_removed"], r["first_ids"]) for r in found.collect())
    assert members == [(False, 1, 120, 120, 0, [1]), (False, 2, 121, 120, 120, [1]), (True, None, 120, 120, 120, [1])]
