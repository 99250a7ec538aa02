"""Rank correlation of two models' similarities over all pairs of rows, without a pair ever being a row.

A similarity is a whole number of billionths, its cell. Each task makes the pairs of two groups of rows as
matrices and counts them by level, ``WIDTH`` cells to a level; a second time, it sums the products of the levels'
mean ranks. What ranks within a level may add has a bound (by Cauchy and Schwarz, over what the levels leave
unexplained). Where the bound leaves the digits open, the fullest levels are counted by cell, which holds ties
exactly; where they are still open, the answer is None. The pairs are made anew for each pass: work grows with
the square of the rows, disk with the rows alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import fsum, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.lineage import materialised
from lumenframe.operators.evaluation import spearman_p

CELLS, WIDTH = 10**9, 128
#: Levels from -1 to 1. The last but one holds 1 alone, the last what is not a number.
LEVELS = 2 * CELLS // WIDTH + 2
#: Levels that are counted by cell where need be, and levels to a row of counts.
FULLEST, CHUNK = 1 << 15, 1 << 18
#: Rows of a group at most, and rows of a matrix.
GROUP, TILE = 49152, 512


def similarities(batches: Iterator[pa.RecordBatch], other: list | None = None) -> Iterator[list[np.ndarray]]:
    """Both models' similarities of the pairs of each two groups, some thousands at a time, from rows
    (low, high, side, a, b, ...) in that order; rows of side -1 are put into ``other``."""
    key, held = None, None
    for batch in batches:
        at = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
        edges = np.flatnonzero((np.diff(at, axis=0) != 0).any(axis=1)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(at)]):
            if start == end:
                continue
            piece = batch.slice(start, end - start)
            low, high, side = at[start].tolist()
            if side < 0:
                other.append(piece)
                continue
            new = [piece.column(i).flatten().to_numpy(zero_copy_only=False).reshape(len(piece), -1) for i in (3, 4)]
            if side == 0:
                if (low, high) != key:
                    key, held = (low, high), None
                if low == high:
                    # A group with itself: what has come before, and the new rows among themselves.
                    if held is not None:
                        yield from _between(held, new)
                    yield from _within(new)
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            elif (low, high) == key:
                yield from _between(held, new)


def _between(left: list[np.ndarray], right: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(left[0]), TILE):
        for j in range(0, len(right[0]), TILE):
            yield [(x[i : i + TILE] @ y[j : j + TILE].T).ravel() for x, y in zip(left, right)]


def _within(rows: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    for i in range(0, len(rows[0]), TILE):
        own = [x[i : i + TILE] for x in rows]
        upper = np.triu_indices(len(own[0]), 1)
        yield [(x @ x.T)[upper] for x in own]
        yield from _between(own, [x[i + TILE :] for x in rows])


def met(rows: DataFrame, groups: int) -> DataFrame:
    """(low, high, side, a, b) of rows (k, a, b): each two groups meet once."""
    mine = F.pmod("k", F.lit(groups)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    return rows.select(mine.alias("mine"), other, "a", "b").select(
        F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "a", "b"
    )


def _slots(full: np.ndarray) -> np.ndarray | None:
    if not len(full):
        return None
    slots = np.full(LEVELS, -1, np.int32)
    slots[full] = np.arange(len(full))
    return slots


def _levels(sims: np.ndarray, slots: np.ndarray | None) -> np.ndarray:
    """The level of each similarity; from LEVELS on, the cells of levels that have a slot."""
    cells = sims * CELLS
    np.rint(cells, out=cells)
    cells += CELLS
    if np.isnan(cells.sum()):
        cells[np.isnan(cells)] = 2 * CELLS + WIDTH
    cells = cells.astype(np.int64)
    if slots is None:
        cells >>= 7
        return cells
    level = cells >> 7
    slot = slots[level]
    return np.where(slot < 0, level, LEVELS + slot.astype(np.int64) * WIDTH + (cells & (WIDTH - 1)))


def _counter(full: list[np.ndarray]):
    """Counts of pairs by level of either model: rows (model, chunk, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, slots, held = None, [_slots(f) for f in full], 0

        def close() -> Iterator[pa.RecordBatch]:
            for model, c in enumerate(counts or ()):
                for chunk in range(-(-len(c) // CHUNK)):
                    part = c[chunk * CHUNK : (chunk + 1) * CHUNK]
                    if part.any():
                        yield _row(model, chunk, part.astype(np.int64) if part.max() > 255 else part.astype(np.uint8))

        for sims in similarities(batches):
            if counts is None:
                counts = [np.zeros(LEVELS + len(f) * WIDTH, np.uint32) for f in full]
            if held + len(sims[0]) >= 1 << 32:
                yield from close()
                for c in counts:
                    c[:] = 0
                held = 0
            held += len(sims[0])
            for c, s, slot in zip(counts, sims, slots):
                np.add.at(c, _levels(s, slot), np.uint32(1))
        yield from close()

    return run


COUNTS = "model int, chunk int, wide boolean, counts binary"


def _row(model: int, chunk: int, part: np.ndarray) -> pa.RecordBatch:
    values = [[model], [chunk], [part.dtype == np.int64], [zlib.compress(part.tobytes(), 1)]]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.bool_(), pa.binary()))], names=["model", "chunk", "wide", "counts"])


def _read(wide: bool, counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int64 if wide else np.uint8)


def _summed(table: pa.Table) -> pa.Table:
    total = 0
    for wide, counts in zip(table["wide"], table["counts"]):
        total = total + _read(wide.as_py(), counts.as_py()).astype(np.int64)
    return pa.Table.from_batches([_row(table["model"][0].as_py(), table["chunk"][0].as_py(), total)])


def _fullest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(model, level, n): the fullest levels of each chunk."""
    for batch in batches:
        for row in batch.to_pylist():
            c = _read(row["wide"], row["counts"])
            best = np.argsort(-c, kind="stable")[:FULLEST]
            best = best[c[best] > 1]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), row["model"], np.int32)), pa.array(best + row["chunk"] * CHUNK), pa.array(c[best])], names=["model", "level", "n"])


def _ranks(counts: np.ndarray, full: np.ndarray, pairs: int) -> tuple[np.ndarray, float, float]:
    """Of counts by level: mean ranks less the mean of all, the sum of their squares over pairs, and the most that the squares of ranks within levels sum up to."""
    cells = counts[LEVELS:].reshape(-1, WIDTH)
    counts[full] = cells.sum(axis=1)
    ranks = np.empty(len(counts))
    np.cumsum(counts[:LEVELS], out=ranks[:LEVELS])
    starts = ranks[full] - counts[full]
    counts[full] = 0
    ranks[LEVELS:] = (starts[:, None] + np.cumsum(cells, axis=1)).ravel()
    ranks -= pairs / 2
    shared = counts[: LEVELS - 2]
    within = (np.einsum("i,i,i->", shared, shared, shared) - shared.sum()) / 12
    # In place, as the arrays are large.
    counts /= 2
    ranks -= counts
    return ranks, 2 * float(np.einsum("i,i,i->", counts, ranks, ranks)), float(within)


def _correlator(full: list[np.ndarray], pairs: int):
    """Sums of products of mean ranks: rows (ab, aa, bb, da, db)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums, other = None, [], []
        slots = [_slots(f) for f in full]
        for sims in similarities(batches, other):
            if found is None:
                found = []
                for model, f in enumerate(full):
                    counts = np.zeros(LEVELS + len(f) * WIDTH)
                    for piece in other:
                        for m, chunk, wide, c in zip(*(piece.column(i).to_pylist() for i in range(5, 9))):
                            if m == model:
                                part = _read(wide, c)
                                counts[chunk * CHUNK : chunk * CHUNK + len(part)] = part
                    found.append(_ranks(counts, f, pairs))
            other.clear()
            a, b = (ranks[_levels(s, slot)] for s, slot, (ranks, _, _) in zip(sims, slots, found))
            sums.append(float(a @ b))
        if found:
            values = [fsum(sums), found[0][1], found[1][1], found[0][2], found[1][2]]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["ab", "aa", "bb", "da", "db"])

    return run


def _interval(ab: float, aa: float, bb: float, da: float, db: float) -> tuple[float, float, float]:
    """The correlation of the levels' mean ranks, and between which values that of the ranks lies."""
    rho = ab / sqrt(aa * bb)
    open_ = sqrt(max(0.0, 1 - rho * rho) + 1e-15)
    error = open_ * (sqrt(aa * db) + sqrt(bb * da)) + sqrt(da * db)
    ends = [(ab + e) / sqrt(size) for e in (-error, error) for size in (aa * bb, (aa + da) * (bb + db))]
    inside = lambda r: max(-1.0, min(1.0, r))
    return inside(rho), inside(min(ends) - 1e-12), inside(max(ends) + 1e-12)


def correlation(rows: DataFrame, n: int, digits: int = 6, edges: tuple[float, ...] = (0.6, 0.8)) -> tuple[float | None, float | None] | None:
    """(rho, p) over all pairs of ``n`` rows (k, a, b); rho is on the right side of each of ``edges``, and both have
    ``digits`` right digits. None where they can't be told."""
    spark, pairs = rows.sparkSession, n * (n - 1) // 2
    groups = -(-n // GROUP)
    while groups * (groups + 1) // 2 < spark.sparkContext.defaultParallelism:
        groups += 1
    tasks = groups * (groups + 1) // 2
    dealt = met(rows, groups)
    # Groups that meet themselves come last: then no range has more of the work than a task of two groups.
    placed_by = (F.col("low") == F.col("high"), "low", "high")
    full = [np.zeros(0, np.int64)] * 2
    for refined in (False, True):
        placed = dealt.repartitionByRange(tasks, *placed_by).sortWithinPartitions("low", "high", "side")
        counts = materialised(placed.mapInArrow(_counter(full), COUNTS).groupBy("model", "chunk").applyInArrow(_summed, COUNTS))
        each = spark.createDataFrame([(i, j) for i in range(groups) for j in range(i, groups)], "low int, high int")
        sent = each.crossJoin(counts).withColumn("side", F.lit(-1))
        both = dealt.unionByName(sent, allowMissingColumns=True).select("low", "high", "side", "a", "b", "model", "chunk", "wide", "counts")
        placed = both.repartitionByRange(tasks, *placed_by).sortWithinPartitions("low", "high", "side")
        sums = placed.mapInArrow(_correlator(full, pairs), "ab double, aa double, bb double, da double, db double").collect()
        ab, (_, aa, bb, da, db) = fsum(r["ab"] for r in sums), sums[0]
        if min(aa, bb) > 0:
            rho, low, high = _interval(ab, aa, bb, da, db)
            p = [spearman_p(r, pairs) for r in (rho, low, high)]
            if round(low, digits) == round(high, digits) and not any(low < e <= high for e in edges) and len({round(x, digits) for x in p}) == 1:
                return rho, p[0]
        elif min(aa + da, bb + db) == 0:
            return None, None
        if not refined:
            best = counts.mapInArrow(_fullest, "model int, level long, n long")
            full = [np.sort(np.array([r["level"] for r in best.filter(F.col("model") == m).orderBy(F.col("n").desc(), "level").limit(FULLEST).collect()], np.int64)) for m in (0, 1)]
    return None
