"""Nearest terms over all the documents' words against brute force."""

from __future__ import annotations

import re
from collections import Counter

from lumenframe.plans import catalogue

SMALL = "/root/testdata/sf0.001"
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def near(token):
    """The token and all forms one edit away, with the distance."""
    cuts = [(token[:i], token[i:]) for i in range(len(token) + 1)]
    one = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in LETTERS} | {a + c + b[1:] for a, b in cuts if b for c in LETTERS}
    return [(token, 0), *((x, 1) for x in one - {token})]


def test_lookup_of_all_words(spark):
    found = lambda table, c: Counter(w for r in spark.read.parquet(f"{SMALL}/{table}.parquet").collect() for w in re.findall("[a-z]+", (r[c] or "").lower()))
    freq = found("documents", "text")
    want = {}
    for token in {*found("pages", "url"), *(t[1:] for t in freq)} - {""}:
        hits = [(d, -freq[x], x) for x, d in near(token) if x in freq]
        if hits:
            want[token] = (min(hits)[2], min(hits)[0])
    got = {r["token"]: (r["term"], r["distance"]) for r in catalogue.QUERIES["delete_neighborhood_lookup"](spark, SMALL).collect()}
    assert got == want
    assert any(len(t) > 8 for t, _ in got.values()) and any(len(t) < 3 for t, _ in got.values())
