r"""Exact substring dedup with sparse suffix arrays.

A passage is ``min_words`` or more consecutive words (``[^\x20\x09-\x0D]+``, letter case kept). It
is repeated where the same words stand elsewhere, in another document or further on in the same.

Suffixes are kept only at minimisers: of each window of ``min_words`` words, the leftmost of its
smallest ``gram``-word hashes. Equal windows choose the same place, so a repeated passage has
kept suffixes at equal places in all its copies. The windows that choose a suffix, with their
words left and right of it, are its cell.

1. Kept suffixes (one pass over the texts, written as a table). One whose first ``gram`` words
   stand nowhere else is dropped. Of equal cells, one of the smallest document stands for all.
2. Cells that share their first words but are not all equal make the sparse suffix array: they
   are sorted by the words that follow, range by range, and each is compared with its neighbours.
   No other suffix agrees with one for longer to the right than its neighbours do, so a window
   that needs more words than that is its own cell's alone.
3. The windows that are left are extended to the left and to the right of the suffix, word for word
   (hash of all their words), and matched. That finds the ends of passages, where copies go on
   differently. Neighbours alone do not decide it: the suffix that agrees longest to the right may
   agree less to the left than one further off.
4. Each cell's repeated windows go back to all its copies as bit masks, one for each document that
   holds them first, and are merged into spans per document.

Comparisons that may meet a very common passage are counts by hash (128 bits) that combine before the
shuffle, and joins against one row per hash, which Spark may split. The sort is by range, with ties cut apart.
No group is held in one task, and pairs are never listed. The Python steps take rows by what they weigh
(bytes of text, cells, masks), so what a task holds beyond one Arrow batch and one text does not grow with either.

The first occurrence, in the order of doc_id and then position, stays; words that later ones
cover are marked for removal.

Defined results: texts of fewer words, empty and null texts have no passage; very long texts are hashed and
cut into cells whole, in one task; null ids sort last;
rows that share a doc_id count as one place for the order, so none of them goes for another's
sake; equal texts, repeated rows too, are repeated in whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lumenframe.lineage import Scratch
from lumenframe.llm.words import counted_apart, id_and_text, space_words

MIN_WORDS = 50
GRAM = 16
#: Bytes of text, and of what is told of their cells, that are taken at once where that is more than one text.
TEXT_BYTES, CELL_BYTES = 1 << 22, 512
#: Documents whose cells are merged at a time, and their masks where that is more than one document.
DOCUMENTS, MASKS = 512, 1 << 17
#: Words up to which powers are kept from text to text.
MOST_POWERS = 1 << 16
#: Odd multipliers of the two rolling hashes.
_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _slices(weights: np.ndarray, most: int, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of ``rows`` rows and a weight of ``most`` at most; a heavier row is a run of its own."""
    ends = np.concatenate(([0], np.cumsum(weights, dtype=np.int64)))
    at = 0
    while at < len(weights):
        fits = int(np.searchsorted(ends, ends[at] + most, "right")) - 1
        end = min(max(fits, at + 1), at + (rows or len(weights)), len(weights))
        yield at, end
        at = end


def _text_bytes(texts: pa.Array) -> np.ndarray:
    return pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _new_powers(size: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64."""
    inverse = pow(_FACTORS[which], -1, 1 << 64)
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, f, np.uint64))]) for f in (_FACTORS[which], inverse))


_kept_powers = lru_cache(16)(_new_powers)


def _powers(words: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers for a text of so many words; only those of usual lengths are kept."""
    return _kept_powers(1 << max(10, words.bit_length()), which) if words < MOST_POWERS else _new_powers(words, which)


class Rolling:
    """Hashes of any run of a document's words from prefix sums, modulo 2**64."""

    def __init__(self, hashes: np.ndarray, which: int):
        up, self.down = _powers(len(hashes), which)
        if which:
            hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (self.sums[end] - self.sums[start]) * self.down[start]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    words = space_words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its smallest, the leftmost of equals."""
    best, place, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        best = np.minimum(left, right)
        place = np.where(right < left, place[step:], place[:-step])
        span += step
    return place


def cells(hashes: np.ndarray, min_words: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, cell hash, place, first window, last window) of each kept suffix."""
    n = len(hashes)
    if n < min_words:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    roll = Rolling(hashes, 0)
    starts = np.arange(n - gram + 1)
    grams = roll.run(starts, starts + gram)
    chosen = leftmost_minima(grams, min_words - gram + 1)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    last = np.concatenate((first[1:], [len(chosen)])) - 1
    at = chosen[first]
    # The place of the gram in the cell is part of what a cell is.
    whole = Rolling(hashes, 1).run(first, last + min_words) ^ (at - first).astype(np.uint64) * np.uint64(_FACTORS[0])
    return grams[at], whole, at, first, last


def seen_before(hashes: np.ndarray, grams: np.ndarray, first: np.ndarray, last: np.ndarray, min_words: int) -> np.ndarray:
    """For each cell, bits of its windows that stood earlier in the same text."""
    out = np.zeros(len(first), np.int64)
    # Equal windows have equal grams, so only cells whose gram comes again need a look.
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    if not (mine := np.flatnonzero(twice)).size:
        return out
    sizes = last[mine] - first[mine] + 1
    of = np.repeat(mine, sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[of]
    w1, w2 = (Rolling(hashes, k).run(at, at + min_words) for k in (0, 1))
    order = np.lexsort((at, w2, w1))
    again = order[1:][(w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])]
    np.bitwise_or.at(out, of[again], np.int64(1) << (at[again] - first[of[again]]))
    return out


CELL = T.StructType([T.StructField(n, t, False) for n, t in (
    ("g", T.LongType()), ("c", T.LongType()), ("t1", T.LongType()), ("n_words", T.IntegerType()), ("at", T.IntegerType()),
    ("first", T.IntegerType()), ("size", T.IntegerType()), ("again", T.LongType()),
)])


def _kept_suffixes(rows: DataFrame, min_words: int, gram: int) -> DataFrame:
    """doc_id and CELL of each kept suffix of (doc_id, t1, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, end - at) for b in batches for at, end in _slices(_text_bytes(b.column(2)), TEXT_BYTES)):
            found, counts, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                hashes = word_hashes(text)
                g, c, at, first, last = cells(hashes, min_words, gram)
                found.append((g.view(np.int64), c.view(np.int64), at, first, last - first + 1, seen_before(hashes, g, first, last, min_words)))
                counts.append(len(hashes))
                sizes.append(len(g))
            of = np.repeat(np.arange(len(sizes)), sizes)
            g, c, at, first, size, again = (np.concatenate(x) for x in zip(*found))
            narrow = [pa.array(x.astype(np.int32)) for x in (np.array(counts)[of], at, first, size)]
            arrays = [batch.column(0).take(pa.array(of)), pa.array(g), pa.array(c), batch.column(1).take(pa.array(of)), *narrow, pa.array(again)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", *CELL.names])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], *CELL.fields]))


def _contexts(rows: DataFrame, min_words: int) -> DataFrame:
    """(g, c, n, lowest, at_left, right, w) of each cell of (text, cells): the words before its suffix, counted, those
    from it on, as sortable bytes, and the hash of each of its windows."""
    inner = rows.schema["cells"].dataType.elementType
    schema = T.StructType([*(inner[k] for k in ("g", "c", "n", "lowest")), T.StructField("at_left", T.IntegerType()), T.StructField("right", T.BinaryType()), T.StructField("w", T.ArrayType(T.LongType()))])

    span = np.arange(min_words)

    def told(texts: list[str | None], flat: pa.StructArray, ends: np.ndarray) -> pa.RecordBatch:
        at, first, size = (flat.field(flat.type.get_field_index(k)).to_numpy().astype(np.int64) for k in ("at", "first", "size"))
        right, windows = np.empty((len(flat), min_words), ">u4"), []
        for i, text in enumerate(texts):
            a, f, n = (x[ends[i] : ends[i + 1]] for x in (at, first, size))
            hashes = word_hashes(text)
            # Word codes of 32 bits, 0 where the cell ends: a code that two words share could only make neighbours look more alike.
            codes = np.concatenate([(hashes >> np.uint64(32)).astype(">u4") | np.array(1, ">u4"), np.zeros(min_words, ">u4")])
            own = right[ends[i] : ends[i + 1]]
            own[:] = sliding_window_view(codes, min_words)[a]
            own[span >= (f + n - 1 + min_words - a)[:, None]] = 0
            where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(f, n)
            windows.append(Rolling(hashes, 0).run(where, where + min_words).view(np.int64))
        rights = pa.Array.from_buffers(pa.binary(), len(flat), [None, pa.py_buffer(np.arange(len(flat) + 1, dtype=np.int32) * 4 * min_words), pa.py_buffer(right)])
        lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), np.concatenate(windows))
        return pa.RecordBatch.from_arrays([*(flat.field(flat.type.get_field_index(k)) for k in ("g", "c", "n", "lowest")), pa.array((at - first).astype(np.int32)), rights, lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(1).flatten(), batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            for start, end in _slices(_text_bytes(batch.column(0)) + CELL_BYTES * np.diff(ends), TEXT_BYTES):
                yield told(batch.column(0).slice(start, end - start).to_pylist(), flat.slice(ends[start], ends[end] - ends[start]), ends[start : end + 1] - ends[start])

    return rows.select("text", "cells").mapInArrow(run, schema)


def common_prefix(rights: np.ndarray) -> np.ndarray:
    """How many words each row of codes agrees in with the next."""
    differ = rights[1:] != rights[:-1]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rights.shape[1])


def _neighbours(rows: DataFrame, min_words: int) -> DataFrame:
    """Of cells sorted by (g, right): (g, c, n, lowest, windows: those that need no more words to the right
    than a neighbour agrees in), each as (i, w). ``at_left`` is how many words stand before the suffix in the first window."""
    schema = T.StructType([
        *(rows.schema[k] for k in ("g", "c", "n", "lowest")),
        T.StructField("windows", T.ArrayType(T.StructType([T.StructField("i", T.IntegerType()), T.StructField("w", T.LongType())]))),
    ])
    names = rows.schema.names

    def emit(batch: pa.RecordBatch, agree: np.ndarray) -> pa.RecordBatch:
        lists, left = batch.column(names.index("w")), batch.column(names.index("at_left")).to_numpy()
        sizes = np.diff(lists.offsets.to_numpy())
        of = np.repeat(np.arange(len(sizes)), sizes)
        i = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # Window i starts left - i words before the suffix and needs the rest of its words after it.
        live = min_words - (left[of] - i) <= agree[of]
        ends = np.concatenate(([0], np.cumsum(np.bincount(of[live], minlength=len(sizes))))).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(i[live].astype(np.int32)), lists.flatten().filter(pa.array(live))], names=["i", "w"])
        return pa.RecordBatch.from_arrays([*(batch.column(names.index(k)) for k in ("g", "c", "n", "lowest")), pa.ListArray.from_arrays(ends, pairs)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A row at the edge of a range has a neighbour that is not seen: it counts as agreeing throughout.
        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            agree, after = _agreement(table, names, before, min_words)
            if table.num_rows > 1:
                yield emit(table.slice(0, table.num_rows - 1), agree[:-1])
            held, before = table.slice(table.num_rows - 1), after
        if held is not None:
            yield emit(held, np.array([min_words]))

    return rows.mapInArrow(run, schema)


def _agreement(table: pa.RecordBatch, names: list[str], before: int | None, min_words: int) -> tuple[np.ndarray, int]:
    """Each row's longest agreement with a neighbour, and that of the last row with the one before it."""
    g = table.column(names.index("g")).to_numpy()
    rights = np.frombuffer(b"".join(table.column(names.index("right")).to_pylist()), ">u4").reshape(len(g), min_words)
    step = np.where(g[1:] == g[:-1], common_prefix(rights), 0)
    up = np.concatenate(([min_words if before is None else before], step))
    down = np.concatenate((step, [min_words]))
    return np.maximum(up, down), int(up[-1])


def _runs(mask: int) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of set bits."""
    while mask:
        first = (mask & -mask).bit_length() - 1
        rest = mask >> first
        size = (rest ^ (rest + 1)).bit_length() - 1
        yield first, first + size - 1
        mask &= ~(((1 << size) - 1) << first)


def _touching(spans: list[tuple[int, int]]) -> list[dict]:
    """Spans merged where they touch."""
    out: list[dict] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def _merged(rows: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, n_words, spans, removed, first_ids) of each (doc_id, n_words, found: array of cells with masks)."""
    span = "array<struct<start:int,end:int>>"
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words int, spans {span}, removed {span}, first_ids array<{kind}>"

    def flat(lists: pa.ListArray) -> tuple[list[int], pa.StructArray]:
        ends = lists.offsets.to_numpy()
        return (ends - ends[0]).tolist(), lists.flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            cells_of, found = flat(whole.column(2))
            counts = np.diff(np.array(flat(found.field("masks"))[0], np.int64)[cells_of])
            for batch in (whole.slice(at, end - at) for at, end in _slices(counts, MASKS, DOCUMENTS)):
                cells_of, found = flat(batch.column(2))
                masks_of, masks = flat(found.field("masks"))
                firsts, agains = (found.field(k).to_pylist() for k in ("first", "again"))
                lowests, bits = (masks.field(k).to_pylist() for k in ("lowest", "mask"))
                out: list[tuple] = []
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    both, gone = [], []
                    for cell in range(cells_of[i], cells_of[i + 1]):
                        for k in range(masks_of[cell], masks_of[cell + 1]):
                            later = bits[k] if lowests[k] is not None and lowests[k] != doc else agains[cell] & bits[k]
                            both += [(firsts[cell] + x, firsts[cell] + y + min_words) for x, y in _runs(bits[k])]
                            gone += [(firsts[cell] + x, firsts[cell] + y + min_words) for x, y in _runs(later)]
                    ids = set(lowests[masks_of[cells_of[i]] : masks_of[cells_of[i + 1]]])
                    out.append((_touching(both), _touching(gone), sorted(ids - {None}) + [None] * (None in ids)))
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out), arrow)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "n_words", "spans", "removed", "first_ids"])

    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrow = [spans_kind, spans_kind, pa.list_(to_arrow_type(rows.schema["doc_id"].dataType))]
    return rows.mapInArrow(run, schema)


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """One row for each document with a repeated passage: (doc_id, n_words, n_repeated, n_removed,
    spans, removed, first_ids): its spans of repeated words, those of them that go as later
    occurrences, and the documents that hold the first occurrences."""
    if not 0 < gram <= min_words or min_words - gram > 61:
        raise ValueError("a gram has 1 to min_words words, and at most 61 less than a window")
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("t1"), "text")
    with Scratch(docs.sparkSession, "suffixes") as scratch:
        return _repeated(rows, scratch, min_words, gram)


def _repeated(rows: DataFrame, scratch: Scratch, min_words: int, gram: int) -> DataFrame:
    """``repeated_passages`` of (doc_id, t1, text), checkpointed."""
    # 1: suffixes whose first words come again, and classes of equal cells.
    kept = scratch.table(_kept_suffixes(rows, min_words, gram), "kept")
    shared = counted_apart(kept, ["g"], F.count("*").alias("n")).filter("n > 1").select("g")
    alike = scratch.table(kept.join(shared, "g").select(*kept.columns), "alike")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "first", "at", "size")
    classes = scratch.table(counted_apart(alike, ["g", "c"], F.count("*").alias("n"), F.min(place).alias("p")), "classes")
    # 2: the suffix array of cells that share their first words without being all equal.
    several = counted_apart(classes, ["g"], F.count("*").alias("kinds")).filter("kinds > 1").select("g")
    mixed = classes.join(several, "g").select(
        F.col("p.doc_id").alias("doc_id"), F.col("p.t1").alias("t1"), F.struct("g", "c", "n", F.col("p.doc_id").alias("lowest"), "p.at", "p.first", "p.size").alias("cell")
    )
    mixed = mixed.groupBy(F.col("doc_id").alias("o_id"), F.col("t1").alias("o_t1")).agg(F.collect_list("cell").alias("cells"))
    texts = rows.join(mixed, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("t1") == F.col("o_t1")))
    contexts = scratch.table(_contexts(texts, min_words), "contexts")
    ordered = contexts.repartitionByRange("g", "right", "c").sortWithinPartitions("g", "right", "c")
    live = scratch.table(_neighbours(ordered, min_words), "live").select("g", "c", "n", "lowest", F.inline("windows"))
    # 3: windows that stand in one cell more, and the document that has each first.
    met = counted_apart(live, ["g", "w"], F.sum("n").alias("total"), F.min("lowest").alias("lowest")).filter("total > 1")
    found = live.select("g", "c", "i", "w").join(met, ["g", "w"]).groupBy("g", "c", "lowest").agg(F.expr("bit_or(shiftleft(1L, i))").alias("mask"))
    found = found.groupBy("g", "c").agg(F.collect_list(F.struct("lowest", "mask")).alias("masks"))
    masks = F.coalesce("masks", F.array().cast(found.schema["masks"].dataType))
    seen = F.aggregate(masks, F.lit(0).cast("long"), lambda s, m: s.bitwiseOR(m["mask"]))
    rest = F.when(F.col("n") > 1, F.expr("shiftleft(1L, p.size) - 1").bitwiseAND(F.bitwise_not(seen))).otherwise(F.lit(0))
    own = F.filter(F.array(F.struct(F.col("p.doc_id").alias("lowest"), rest.cast("long").alias("mask"))), lambda m: m["mask"] != 0)
    ruled = classes.join(found, ["g", "c"], "left").select("g", "c", F.concat(masks, own).alias("masks")).filter(F.size("masks") > 0)
    ruled = scratch.table(ruled, "ruled")
    # 4: back to every copy.
    # A set, which is combined before the shuffle: of rows that are repeated, however often, each cell comes once.
    members = alike.join(ruled, ["g", "c"]).groupBy("doc_id", "t1", "n_words").agg(F.collect_set(F.struct("first", "again", "masks")).alias("found"))
    merged = _merged(members.select("doc_id", "n_words", "found"), min_words)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return merged.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), total("spans").alias("n_repeated"), total("removed").alias("n_removed"), "spans", "removed", "first_ids",
    ).checkpoint()
