"""Quality by nearest-neighbour voting in a latent-semantic space.

A document is a weighted bag of hashed terms in three families: its words, the shapes of its
words (runs of upper case, lower case, digits, and punctuation as it stands), and levels of
whole-text measurements (length, symbols, repeats, capitals). Document frequencies come from all
documents. A bounded sample of labelled documents spans the latent space (truncated singular
value decomposition); their vectors are broadcast (``2 * per_label`` rows of ``rank`` numbers at
most), and every document's cosines with all of them are computed in blocks. The score is the
labels' mean over the ``neighbours`` most similar, weighted by similarity.

Labels, language, source and ids are never inputs of a score. Defined results: null and empty
texts have only their measurements' terms, so a vector and a score all the same; very long texts are counted whole; of
equally similar neighbours those of the smallest ids vote; repeated rows score alike, in whatever block they come; of
several texts under one labelled id the smallest is learnt from; an empty table gives no rows; a sample of no rows gives 0.5 throughout, one label alone gives that label;
other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import quality_rules
from lumenframe.llm.held_out import held_out, training_sample
from lumenframe.llm.words import id_and_text, space_words

WORD_TERMS, SHAPE_TERMS, LEVEL_TERMS = 4096, 1024, 512
TERMS = WORD_TERMS + SHAPE_TERMS + LEVEL_TERMS
#: Weight of each family in a document's vector, each family being of unit length.
WEIGHTS = (0.4, 1.0, 1.2)
PER_LABEL = 1500
RANK = 64
NEIGHBOURS = 15
BLOCK = 1024
#: Terms of several documents that are projected at a time.
GATHER = 1 << 15
#: Parts of one in which latent vectors are counted: 64 products of two such numbers stay below 2 ** 53.
ONE = float(1 << 20)
#: Distinct words whose terms a task keeps.
MOST_WORDS = 300_000
SCORE_AT = 0.3

_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))


def _shape(word: bytes) -> bytes:
    """``Word!!`` to ``Aa!``: character classes, runs written once."""
    kinds = word.translate(_SHAPE)
    return bytes(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)


def _level(share: float) -> int:
    """Coarse steps of a share of 0 to 1 and beyond."""
    return bisect_left((1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 1.5), share)


def level_terms(measures: tuple[int, ...]) -> list[int]:
    m = dict(zip(quality_rules.MEASURES, measures))
    words, lines, letters = max(m["n_words"], 1), max(m["n_lines"], 1), max(m["n_letters"], 1)
    levels = (
        min(m["n_words"].bit_length(), 24), _level(m["n_symbols"] / words), _level(m["n_dup_lines"] / lines),
        _level(m["n_repeat_words"] / words), _level(m["n_upper"] / letters), _level(m["n_adjacent"] / words),
        _level(abs(m["n_letters"] / max(m["word_chars"], 1) - 1)), min(int(m["word_chars"] / words), 24),
    )
    return [32 * i + level for i, level in enumerate(levels)]


class Terms(dict):
    """Term counts of whole texts; as a dictionary, the two terms of each word met, in one number."""

    def __missing__(self, word: bytes) -> int:
        digest = xxhash.xxh3_64_intdigest
        self[word] = both = digest(word.lower()) % WORD_TERMS * SHAPE_TERMS + digest(_shape(word)) % SHAPE_TERMS
        return both

    def count(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted terms of a text and their counts."""
        if len(self) >= MOST_WORDS:
            self.clear()
        words = space_words(text)
        both = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        counts = np.zeros(TERMS, np.int64)
        counts[:WORD_TERMS] = np.bincount(both // SHAPE_TERMS, minlength=WORD_TERMS)
        counts[WORD_TERMS : WORD_TERMS + SHAPE_TERMS] = np.bincount(both % SHAPE_TERMS, minlength=SHAPE_TERMS)
        counts[[WORD_TERMS + SHAPE_TERMS + t for t in level_terms(quality_rules.measure(text, words))]] = 1
        terms = np.flatnonzero(counts)
        return terms, counts[terms]


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """How many of all documents have each term, and in the last place the number of documents.

    Each task sums its own counts; the total has ``TERMS`` numbers whatever the table's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(), np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total[terms.count(text)[0]] += 1
                total[TERMS] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["term", "n"])

    summed = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(TERMS + 1, np.int64)
    for row in summed.collect():
        out[row["term"]] = row["n"]
    return out


@dataclass
class Model:
    """``vectors`` holds the sample's latent vectors as whole numbers, in the order of their ids."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def weighted(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) of each term of each document, each family scaled to its weight."""
        of = np.repeat(np.arange(len(counted)), [len(t) for t, _ in counted])
        terms, counts = (np.concatenate([c[i] for c in counted]) for i in (0, 1))
        weight = (1 + np.log(counts)) * self.idf[terms]
        family = (terms >= WORD_TERMS).astype(np.int64) + (terms >= WORD_TERMS + SHAPE_TERMS)
        group = len(WEIGHTS) * of + family
        norms = np.sqrt(np.bincount(group, weight**2, len(WEIGHTS) * len(counted)))
        return of, terms, weight * np.array(WEIGHTS)[family] / np.maximum(norms[group], 1e-12)

    def latent(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Unit vectors as whole numbers of ``ONE`` parts: products of them are exact in double, so a cosine is the
        same number whatever the block it is computed in."""
        z, at = np.zeros((len(counted), self.axes.shape[1])), 0
        while at < len(counted):
            end, size = at, 0
            while end < len(counted) and (end == at or size + len(counted[end][0]) <= GATHER):
                size += len(counted[end][0])
                end += 1
            of, terms, weight = self.weighted(counted[at:end])
            z[at:end] = np.add.reduceat(self.axes[terms] * weight[:, None], np.searchsorted(of, np.arange(end - at)), axis=0)
            at = end
        return np.rint(z / np.maximum(np.sqrt((z * z).sum(axis=1, keepdims=True)), 1e-12) * ONE)

    def score(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Votes of the nearest labelled vectors, a block of documents at a time."""
        if not len(self.labels):
            return np.full(len(counted), 0.5)
        out = np.empty(len(counted))
        for at in range(0, len(counted), BLOCK):
            cosines = self.latent(counted[at : at + BLOCK]) @ self.vectors.T / ONE**2
            near = nearest(cosines, min(self.neighbours, len(self.labels)))
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6) ** 4
            out[at : at + BLOCK] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return out


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """For each row the places of its ``k`` largest, in order of place; of equals the first places."""
    least = np.partition(cosines, cosines.shape[1] - k, axis=1)[:, -k][:, None]
    chosen, level = cosines > least, cosines == least
    room = k - chosen.sum(axis=1)
    crowded = np.flatnonzero(level.sum(axis=1) > room)
    level[crowded] &= np.cumsum(level[crowded], axis=1) <= room[crowded, None]
    return np.nonzero(chosen | level)[1].reshape(-1, k)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Model:
    """Learns from at most ``per_label`` documents of each label; the frequencies are of all documents."""
    df = document_frequencies(docs)
    idf = np.log((1 + df[TERMS]) / (1 + df[:TERMS])) + 1
    sample = F.broadcast(training_sample(labels, "quality", per_label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.count(t) for t in batch.column(2).to_pylist()]
            lists = [pa.array([f[i] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["doc_id", "y", "terms", "counts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, y int, terms array<long>, counts array<long>"
    learnt = docs.join(sample, "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = learnt.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    model = Model(idf, np.zeros((TERMS, 1)), np.zeros((0, 1)), rows["y"].to_numpy().astype(float), neighbours)
    if rows.num_rows:
        counted = [tuple(np.array(column[i].values) for column in (rows["terms"], rows["counts"])) for i in range(rows.num_rows)]
        x = np.zeros((len(counted), TERMS))
        of, terms, weight = model.weighted(counted)
        x[of, terms] = weight
        values, vectors = np.linalg.eigh(x @ x.T)
        top = np.argsort(-values)[:rank]
        top = top[values[top] > 1e-9]
        model.axes = (x.T @ vectors[:, top]) / np.sqrt(values[top])
        model.vectors = model.latent(counted)
    return model


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """(doc_id, held_out, score): one row per row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(fit(rows, labels, **parameters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, model = Terms(), sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                found = model.score([terms.count(t) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score")
