"""The entry points with and without what the training-data queries need."""

from __future__ import annotations

import importlib
import sys

import pytest

import __spark_entry__ as entry
from lumenframe.plans import catalogue


def test_every_query_is_callable_and_sql_has_one():
    assert set(catalogue.QUERIES) <= set(entry.queries()) and all(map(callable, entry.queries().values()))
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("missing", ["public_tokenizers", "lumenframe.llm", "corpus_pipeline"])
def test_core_queries_without(monkeypatch, missing):
    """A missing module takes the queries that need it along, and no others."""
    for name in [n for n in sys.modules if n.startswith("lumenframe.llm") or n in ("corpus_pipeline", missing)]:
        monkeypatch.delitem(sys.modules, name)
    for package, name in (("lumenframe", "llm"),):
        monkeypatch.delattr(sys.modules[package], name, raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        found = importlib.reload(entry).queries()
        assert set(catalogue.QUERIES) <= set(found) and "pipeline" not in found
        if missing != "corpus_pipeline":
            assert set(found) == set(catalogue.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
