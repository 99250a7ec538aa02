"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from brute import classes, contamination, line_dedup, simhash
from tokenizers import Tokenizer

import corpus_pipeline
from lumenframe.llm import quality_rules, registry

SMALL = "/root/testdata/sf0.001"


def test_stages_and_result(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in quality_rules.apply_policy(quality_rules.ledger(docs)).filter("kept").collect()}
    texts = line_dedup([(d, rows[d]) for d in kept])
    found = classes([(d, simhash(t)) for d, t in texts.items()])
    texts = {d: texts[d] for d in set(found.values())}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    texts = {d: t for d, t in texts.items() if not contamination(t, items)["contaminated"]}
    library = Tokenizer.from_file(str(public_tokenizers.path(registry.VOCABULARY)))
    got = {r["doc_id"]: list(r["ids"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert got == {d: library.encode(t, add_special_tokens=False).ids for d, t in texts.items()}
    assert 0 < len(got) < len(kept) < len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "BPE encoding and decoding"]


PASSAGE = " ".join(f"word{i} of the passage" for i in range(30))
STORY = " ".join(f"sentence {i} tells of {i * i} things" for i in range(40))
ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, STORY), (5, STORY), (6, "\n".join(f"line {i % 7} stands here again" for i in range(40))), (7, "x" * 50_000), (8, PASSAGE + " and an end"),
    (9, " ".join(f"long{i} text{i}" for i in range(60_000))), (10, STORY.replace("tells", "spoke")), (None, "a null id has " + STORY), (None, None), (4, "the id of another text, said in twelve words or a few more"), (4, STORY),
]
EXTRA = {"lines_removed": 5, "Doc": "d", "fp": "f", "kept": True, "n_words": 3, "gone": "g", "new": "n", "spans": 1, "t1": 2, "root": 3, "fail.bits": 4}


@pytest.fixture
def folder(spark, tmp_path):
    """Awkward documents with columns named like the operators' own, and a benchmark item that one of them holds."""
    names = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", *(f"`{n}` {'string' if isinstance(v, str) else 'boolean' if v is True else 'long'}" for n, v in EXTRA.items())])
    rows = [(i, t, "en", "s", len(t or ""), *EXTRA.values()) for i, t in ROWS]
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, PASSAGE), (2, None), (None, "zz")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_of_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = [c for c in docs.columns if c not in ("text", "n_chars")]
    plain = lambda df: sorted(map(repr, df.select(*[f"`{c}`" for c in extra]).collect()))
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert set(plain(out)) <= set(plain(docs)), name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    texts = lambda name: sorted([(str(r["doc_id"]), r["text"]) for r in stages[name](spark, docs, folder).collect()], key=repr)
    everything = sorted([(str(i), t) for i, t in ROWS], key=repr)
    short = [(str(i), t) for i, t in ROWS if not (t or "").split() or len(t.split()) < 10]
    assert not set(short) & set(texts("quality rules")) and ("4", STORY) in texts("quality rules") and ("9", ROWS[8][1]) in texts("quality rules")
    lines = stages["line dedup"](spark, docs, folder)
    assert lines.count() == len(ROWS) and lines.filter("n_chars <> char_length(text)").count() == 0
    assert [t for i, t in texts("line dedup") if i != "6"] == [t for i, t in everything if i != "6"]
    near = texts("near-duplicates")
    assert ("1", None) in near and not {("2", ""), ("3", " \n\t"), ("5", STORY)} & set(near) and near.count(("4", STORY)) == 1
    clean = texts("decontamination")
    assert clean == [r for r in everything if r[0] != "8"]
    library = Tokenizer.from_file(str(public_tokenizers.path(registry.VOCABULARY)))
    coded = stages["BPE encoding and decoding"](spark, docs, folder).collect()
    assert sorted(r["decoded_sha256"] for r in coded) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in ROWS)
    assert sorted(r["n_tokens"] for r in coded) == sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t in ROWS)


def test_run_over_awkward_and_empty_tables(spark, folder, tmp_path):
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert {4, 9} <= ids and not ids & {1, 2, 3, 5, 8}
    empty = f"{tmp_path}/empty"
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
