"""What BPE encoding holds is bounded by bytes and words, and whole texts come out whatever the bounds."""

from __future__ import annotations

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import bpe, registry

PATH = str(public_tokenizers.path(registry.VOCABULARY))
STORY = " ".join(f"word{i % 700} of it's story {i % 90}," for i in range(25_000))
MB = 1 << 20


def peak_mb(run) -> tuple[float, float]:
    """MB that a call takes beyond what is there already: at most, and still when it is done."""
    tracemalloc.start()
    try:
        run()
        now, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    return most / MB, now / MB


@pytest.fixture
def encoder(monkeypatch):
    monkeypatch.setattr(bpe, "AT_ONCE", 1 << 15, raising=False)
    made = bpe._encoder(PATH)
    made.encode_batch([STORY, "Ж"])
    return made


def test_long_texts_do_not_add_up(encoder):
    texts = [STORY[i:] for i in range(6)]
    most, _ = peak_mb(lambda: encoder.encode_batch(texts))
    assert most < 40, f"{most:.0f} MB for {sum(map(len, texts)) / MB:.0f} MB of text"


def test_one_long_text_is_not_held_word_by_word(encoder):
    text = STORY * 6
    ids, counts = encoder.encode_batch([text])
    assert encoder.decode_batch(ids, counts) == [text]
    most, _ = peak_mb(lambda: encoder.encode_batch([text]))
    back, _ = peak_mb(lambda: encoder.decode_batch(ids, counts))
    assert most < 40 and back < 50, f"{most:.0f} and {back:.0f} MB for {len(text) / MB:.0f} MB of text"


def test_long_words_are_not_kept(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_CHARS", 1 << 20, raising=False)

    def run():
        for at in range(0, 400, 50):
            encoder.encode_batch(["x" * (10_000 + at + i) for i in range(50)])

    _, kept = peak_mb(run)
    assert kept < 3.5, f"{kept:.1f} MB kept"


@pytest.mark.parametrize(("at_once", "most_chars", "text_bytes"), [(1, 1, 1), (7, 50, 300), (1 << 19, 1 << 23, 1 << 22)])
def test_bounds_change_no_result(monkeypatch, at_once, most_chars, text_bytes):
    monkeypatch.setattr(bpe, "AT_ONCE", at_once)
    monkeypatch.setattr(bpe, "MOST_CHARS", most_chars)
    monkeypatch.setattr(bpe, "TEXT_BYTES", text_bytes)
    encoder = bpe._encoder(PATH)
    token = next(iter(encoder.vocabulary.added))
    texts = [None, "", token, f"a{token}{token} b ", STORY[:900], "  \n\t x", "Жук и Ёж", "日本語のテキスト 12 ", "🙂" * 40, "x" * 500, None, "it's", "end  "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    library = Tokenizer.from_file(PATH)
    slices = list(bpe.parts(batch))
    assert [i for part in slices for i in part.column(0).to_pylist()] == list(range(len(texts)))
    assert all(part.num_rows == 1 or sum(len((t or "").encode()) for t in part.column(1).to_pylist()) <= text_bytes for part in slices)
    rows = [r for out in bpe.coded(encoder, iter([batch, batch.slice(0, 0), batch.slice(5, 7)])) for r in out.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(len(texts)), *range(5, 12)]
    for r in rows:
        want = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert (r["ids"], r["n_tokens"], r["decoded"]) == (want, len(want), library.decode(want, skip_special_tokens=False))
    counts = encoder.encode_batch([])[1]
    assert counts.dtype == np.int64 and not len(counts)
