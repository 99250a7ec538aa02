"""Toxic passages by maximum-scoring segments.

Every word has a score from log-odds with an informative Dirichlet prior (Monroe, Colaresi and
Quinn, 2008): how much likelier it is in toxic than in clean labelled documents, the prior being
the counts of all documents (each counts a word once). The word, its first four and its first five letters are counted in
hash buckets of a fixed number; a word scores the best lower bound of its three, or a small
negative drift. A linear-time scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments of
a text. A segment's expected number by chance is K n exp(-lambda S) (Karlin and Altschul, 1990),
lambda being solved from the score distribution of clean text and K set so that the segments found in the clean
sample are as many as expected; the significant ones are the toxic passages. A document's statistic is the sum of their normalised scores, and a logistic
curve fitted on the training sample's statistics calibrates it.

Labels, language, source and ids are never inputs of a score. Defined results: null and empty
texts have no passage and get the score of none; a very long text is scanned whole; segments that tie keep text order;
repeated rows score alike; every row of a labelled id is learnt from; an empty table gives no rows; without both labels in the sample all score the
sample's toxic share (0.5 without any); other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.lineage import ensure_checkpoint_dir
from lumenframe.llm.held_out import held_out, training_sample
from lumenframe.llm.words import alnum_words, id_and_text

BUCKETS = 1 << 18
#: Labelled documents of each label to learn from.
PER_LABEL = 8000
#: Weight of the prior, in words.
PRIOR = 2000.0
#: Standard deviations below an estimate at which a word is scored, and the lowest score that counts.
BELOW, LEAST = 2.0, 1.0
DRIFT = 0.5
#: The expected number by chance from which down a segment is significant.
SIGNIFICANT = 0.05
MOST_WORDS = 300_000


def buckets(word: bytes) -> tuple[int, int, int]:
    """The word's own bucket, and those of its first four and first five bytes."""
    digest = xxhash.xxh3_64_intdigest
    return digest(word, 1) % BUCKETS, digest(word[:4], 4) % BUCKETS, digest(word[:5], 5) % BUCKETS


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), by Ruzzo and Tompa's scan.

    Only positive scores start or end a segment, so the scan steps from one to the next and
    takes the drift between them from prefix sums.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    # Each candidate: start, end, sum before it, sum up to its end; and the nearest earlier
    # candidate whose sum before is smaller.
    found: list[tuple[int, int, float, float, int]] = []
    for at in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = at, at + 1, float(sums[at]), float(sums[at + 1])
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
            j = len(found) - 1
    return [(s, e, r - l) for s, e, l, r, _ in found]


@dataclass
class Model:
    """Bucket scores, the null distribution's decay, and the calibration."""

    bucket_scores: np.ndarray
    decay: float
    k: float = 1.0
    slope: float = 0.0
    offset: float = 0.0
    known: dict[bytes, float] = field(default_factory=dict, repr=False)

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > MOST_WORDS:
            known.clear()
        for word in set(words).difference(known):
            a, b, c = buckets(word)
            best = max(self.bucket_scores[0, a], self.bucket_scores[1, b], self.bucket_scores[2, c])
            known[word] = float(best) if best >= LEAST else -DRIFT
        return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """How many words a text has, and its maximal segments."""
        words = alnum_words(text)
        return len(words), segments(self.word_scores(words))

    def passages(self, text: str | None) -> list[tuple[int, int, float, float]]:
        """Significant segments of words: (start, end, score, expected number by chance)."""
        n, found = self.segments(text)
        expected = [(s, e, x, self.k * n * float(np.exp(-self.decay * x))) for s, e, x in found]
        return [f for f in expected if f[3] <= SIGNIFICANT]

    def statistic(self, passages: list[tuple[int, int, float, float]]) -> float:
        """Sum of -ln of the chance of each passage (Gumbel), 0 where there is none."""
        return float(sum(-np.log(-np.expm1(-p[3])) if p[3] > 1e-12 else -np.log(max(p[3], 1e-300)) for p in passages))

    def calibrated(self, statistic: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(statistic) + self.offset, -30, 30)))


def bucket_counts(docs: DataFrame, sample: dict) -> np.ndarray:
    """Counts [family, 0 all / 1 clean / 2 toxic, bucket] over all documents; ``sample`` has the labels."""
    sent = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, labelled = np.zeros((3, 3, BUCKETS), np.int32), sent.value
        for batch in batches:
            counts = (Counter(), Counter(), Counter())
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(alnum_words(text))  # once a document: one that repeats a word says no more for it
                counts[0].update(words)
                if (y := labelled.get(doc)) is not None:
                    counts[1 + y].update(words)
            for which, counted in enumerate(counts):
                if counted:
                    at = np.array([buckets(w) for w in counted])
                    n = np.fromiter(counted.values(), np.int64, len(counted))
                    for kind in range(3):
                        total[kind, which] += np.bincount(at[:, kind], n, BUCKETS).astype(np.int32)
        for kind in range(3):
            found = np.flatnonzero(total[kind, 0])
            names = ["at", "a", "b", "c"]
            yield pa.RecordBatch.from_arrays([pa.array(found + kind * BUCKETS), *(pa.array(total[kind, i, found].astype(np.int64)) for i in range(3))], names=names)

    rows = docs.mapInArrow(run, "at long, a long, b long, c long").groupBy("at").agg(*[F.sum(x).alias(x) for x in "abc"])
    out = np.zeros((3, 3, BUCKETS), np.int64)
    # At most 3 * BUCKETS rows, whatever the table's size; they come partition by partition.
    packed = rows.coalesce(8).mapInArrow(_packed, "at binary, a binary, b binary, c binary")
    for row in packed.toLocalIterator():
        at, *values = (np.frombuffer(row[i], np.int64) for i in range(4))
        out[at // BUCKETS, :, at % BUCKETS] = np.stack(values, axis=1)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [pa.array([batch.column(i).to_numpy().astype(np.int64).tobytes()], pa.binary()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "a", "b", "c"])


def log_odds(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """For each bucket, the lower bound of its log-odds of toxic against clean."""
    out = np.zeros((3, BUCKETS), np.float32)
    for kind in range(3):
        corpus, clean, toxic = counts[kind].astype(float)
        alpha = prior * (corpus + 0.01) / (corpus.sum() + 0.01 * BUCKETS)
        t, c = toxic + alpha, clean + alpha
        odds = np.log(t / (t.sum() - t)) - np.log(c / (c.sum() - c))
        out[kind] = np.where(toxic > 1, odds - BELOW * np.sqrt(1 / t + 1 / c), -DRIFT)
    return np.minimum(out, 8)


def decay_of(scores: np.ndarray, counts: np.ndarray, prior: float = PRIOR) -> float:
    """lambda: sum of p exp(lambda s) is 1 over the scores of clean words, the prior smoothing p."""
    corpus, clean = counts[0, 0].astype(float), counts[0, 1].astype(float)
    p = clean + prior * (corpus + 0.01) / (corpus.sum() + 0.01 * BUCKETS)
    s = np.where(scores[0] >= LEAST, scores[0], -DRIFT)
    p = p / p.sum()
    low, high = 1e-4, 5.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if float(p @ np.exp(mid * s)) < 1 else (low, mid)
    return low


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method; each point counts ``n`` times."""
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (n * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Learns from at most ``per_label`` documents of each label; the prior is of all documents."""
    ensure_checkpoint_dir(docs.sparkSession)
    chosen = training_sample(labels, "toxic", per_label)
    sample = {r["doc_id"]: r["y"] for r in chosen.collect()}
    toxic = sum(sample.values())
    if not 0 < toxic < len(sample):
        share = np.clip(toxic / len(sample), 1e-6, 1 - 1e-6) if sample else 0.5
        return Model(np.full((3, BUCKETS), -DRIFT, np.float32), 1.0, offset=float(np.log(share / (1 - share))))
    counts = bucket_counts(docs, sample)
    scores = log_odds(counts)
    model = Model(scores, decay_of(scores, counts))
    texts = docs.join(F.broadcast(chosen), "doc_id").select("y", "text").checkpoint()
    model.k = _chance(model, texts.filter("y = 0"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [sent.value.statistic(sent.value.passages(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["y", "x"])

    # Two numbers for each row of a labelled id, so that a repeated id weighs as often as it stands; counted by value first.
    only = texts.mapInArrow(run, "y int, x double").groupBy("y", F.round("x", 3).alias("x")).agg(F.count("*").alias("n")).collect()
    y, x, n = (np.array([r[k] for r in only], float) for k in "yxn")
    model.slope, model.offset = _logistic(np.log1p(x), y, n)
    return model


def _chance(model: Model, clean: DataFrame) -> float:
    """Karlin and Altschul's K: as many segments of ``LEAST`` or more by chance as the clean sample has."""
    sent = clean.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.segments(t) for t in batch.column(1).to_pylist()]
            rows = [[n for n, _ in found], [sum(x >= LEAST for *_, x in s) for _, s in found]]
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["n_words", "n_segments"])

    words, found = clean.mapInArrow(run, "n_words long, n_segments long").agg(F.sum("n_words"), F.sum("n_segments")).first()
    return ((found or 0) + 0.5) * float(np.exp(model.decay * LEAST)) / ((words or 0) + 1)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """(doc_id, held_out, score, passages): one row per row of ``docs``; passages are spans of words."""
    rows = id_and_text(docs, id_col, text_col)
    sent = rows.sparkSession.sparkContext.broadcast(fit(rows, labels, **parameters))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.passages(t) for t in batch.column(1).to_pylist()]
            scores = model.calibrated(np.array([model.statistic(f) for f in found], np.float64))
            lists = pa.array([[dict(zip(("start", "end", "score", "expected"), p)) for p in f] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), lists], names=["doc_id", "score", "passages"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, passages array<struct<start:int,end:int,score:double,expected:double>>"
    return rows.mapInArrow(run, schema).select("doc_id", held_out().alias("held_out"), "score", "passages")
