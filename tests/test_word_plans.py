"""Words are looked up once each, and the SQL of the ratio is difflib's."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import duckdb

from lumenframe.operators import entities
from lumenframe.plans import catalogue, titles

SMALL = "/root/testdata/sf0.001"


def below_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("ArrowEvalPython")[1:]


def test_python_runs_on_distinct_words(spark):
    matched = entities.matched_terms(titles._misread(spark, SMALL), "video_id", "text")
    for df in (catalogue.QUERIES["frequency_corrected"](spark, SMALL), matched):
        parts = below_python(df)
        assert parts and all("HashAggregate" in part.split("Generate")[0] for part in parts)


def test_no_words_are_broadcast(spark):
    matched = entities.matched_terms(titles._misread(spark, SMALL), "video_id", "text")
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("ShuffledHashJoin") == 2


def test_ratio_sql():
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcñ") for _ in range(draw.randint(1, 12)))
    pairs = sorted({(word(), word()) for _ in range(2000)})
    values = ", ".join(f"('{a}', '{b}')" for a, b in pairs)
    rows = duckdb.sql(f"WITH RECURSIVE p(a, b) AS (VALUES {values}), {titles._RATIO} SELECT a, b, ratio FROM ratio").fetchall()
    assert sorted(rows) == [(a, b, SequenceMatcher(None, a, b).ratio()) for a, b in pairs]
