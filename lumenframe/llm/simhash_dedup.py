"""SimHash near-duplicates by tiled exact comparison.

Fingerprints: a bit is set where over half of the hashes of a text's word shingles have it,
repeats included (fewer words than a shingle: the whole sequence; no word: zero). Two
fingerprints link if they differ in at most ``radius`` bits; groups are connected components.

Comparison is exact and among distinct fingerprints only, tile by tile. A tile holds fingerprints
of the same population counts: those of the four spans of 16 bits. Two fingerprints differ in at least as
many bits as their counts differ in all, so tiles whose counts differ by more than the radius are
never compared; all others are, by numpy exclusive-or and bit counts. (The count of all 64 bits
alone leaves over half of the pairs, the four counts about a tenth.) Cells over ``size``
fingerprints are cut into several tiles, dealt by hash, so no task holds a hot cell. A tile is sent
to each tile it meets and compared there with the one that is held: a task holds one tile and
one batch of others. What a comparison emits is a spanning set of its links (each fingerprint to one
root per connected part), so a group of thousands of near copies gives as many rows, not their
pairs. The work grows with the square of the distinct fingerprints; see the README for figures.

Defined results: null and empty texts have fingerprint zero and link like any others; repeated
rows and equal texts share a fingerprint and so a group; ``component_id`` is the smallest non-null
doc_id reachable (null only where all ids are null); an empty table gives no rows; a very long text is
hashed whole, its counts summed piece by piece; other columns are not read, and ``keep_one`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.lineage import ensure_checkpoint_dir
from lumenframe.llm.components import components
from lumenframe.llm.words import counted_apart, id_and_text, quoted

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Spans of 16 bits whose population counts tell tiles apart; five bits hold a count.
SPANS = 4
#: Fingerprints of a tile on average where a cell is cut; how many a side are compared at once.
TILE, BLOCK = 2048, 512
_PIECE = 1 << 16
#: A tile's own fingerprints, and those of a tile that it is compared with; the own ones sort first.
OWN, OTHER = 0, 1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 (UTF-8, seed 42) of each run of ``shingle`` words after lower-casing A-Z."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    k = min(shingle, len(words))
    pairs = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in pairs), np.uint64, len(words) - k + 1)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        piece = np.ascontiguousarray(hashes[at : at + _PIECE])
        counts += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(rows: DataFrame, shingle: int) -> DataFrame:
    """Of (doc_id, t1, text): (doc_id, t1, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "t1", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, t1 long, fp long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long; one row per row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.lit(0).cast("long").alias("t1"), "text")
    return _fingerprints(rows, shingle).drop("t1")


def span_counts(fps: np.ndarray | int) -> np.ndarray:
    """Population counts of the four spans of 16 bits of each fingerprint, in one number: five bits each."""
    fps = np.asarray(fps, np.uint64)
    parts = [np.bitwise_count((fps >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) << 5 * i for i in range(SPANS)]
    return sum(parts)


def _cell(fp: Column) -> Column:
    """``span_counts`` as a column."""
    parts = [F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF))), 5 * i) for i in range(SPANS)]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total.cast("long")


def neighbour_steps(radius: int) -> list[int]:
    """What to add to a cell's number for each cell, itself and those after it, whose counts differ by
    ``radius`` in all at most. Of two such cells one is after the other, so each pair is met once."""
    steps = (range(-radius, radius + 1),) * SPANS
    near = [sum(d << 5 * i for i, d in enumerate(move)) for move in product(*steps) if sum(map(abs, move)) <= radius]
    return sorted(x for x in near if x >= 0)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs, as indexes, between two sets: exclusive-or and bit counts, a block of a size that caches hold at a time."""
    rows, cols = [], []
    for i in range(0, len(left), BLOCK):
        mine = left[i : i + BLOCK, None]
        for j in range(0, len(right), BLOCK):
            x, y = np.nonzero(np.bitwise_count(mine ^ right[None, j : j + BLOCK]) <= radius)
            rows.append(x + i)
            cols.append(y + j)
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(rows), np.concatenate(cols)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of ``n``, over pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new[root]
    return root


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (tile, kind): each tile's own fingerprints come first, then the tiles that are
    to be compared with it. Yields a spanning set of the links."""
    key, own = None, np.empty(0, np.uint64)
    for batch in batches:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []

        def keep(fps: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
            root = spanning(len(fps), x, y)
            far = np.flatnonzero(root != np.arange(len(fps)))
            a.append(fps[far])
            b.append(fps[root[far]])

        tiles, kinds = (batch.column(i).to_numpy() for i in (0, 1))
        lists = batch.column(2)
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy().view(np.uint64)
        edges = np.flatnonzero((np.diff(tiles) != 0) | (np.diff(kinds) != 0)) + 1
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(tiles)]):
            if start == end:
                continue
            fps = flat[ends[start] : ends[end]]
            if kinds[start] == OWN:
                key, own = tiles[start], fps.copy()
                x, y = tile_links(own, own, radius)
                keep(own, x[x < y], y[x < y])
            elif tiles[start] == key:
                x, y = tile_links(own, fps, radius)
                keep(np.concatenate([own, fps]), x, y + len(own))
        pairs = [np.concatenate(v).view(np.int64) if v else np.empty(0, np.int64) for v in (a, b)]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in pairs], names=["a", "b"])


def tiles(fps: DataFrame, radius: int = RADIUS, size: int = TILE) -> DataFrame:
    """(tile, kind, fps): the distinct longs of ``fps.fp`` cut into tiles, each as itself (OWN) and as what is
    to be compared with each tile whose population counts are within the radius (OTHER)."""
    celled = fps.select("fp", _cell(F.col("fp")).alias("cell"))
    counts = celled.groupBy("cell").agg(F.count("*").alias("n"))
    # At most 17 ** 4 = 83,521 rows of two numbers, whatever the size of the table: a span has 0 to 16 bits set.
    parts = F.broadcast(counts.select("cell", F.ceil(F.col("n") / size).cast("long").alias("parts")))
    cut = celled.join(parts, "cell").select("fp", "cell", F.pmod(F.xxhash64("fp"), F.col("parts")).alias("part"))
    packed = cut.groupBy("cell", "part").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    number = lambda cell, part: F.shiftleft(part, 5 * SPANS) + cell
    near = packed.select("cell", "part", "fps", F.explode(F.array(*[F.lit(x).cast("long") for x in neighbour_steps(radius)])).alias("step"))
    near = near.select((F.col("cell") + F.col("step")).alias("to"), "cell", "part", "fps")
    near = near.join(parts.withColumnRenamed("cell", "to"), "to").select("to", "cell", "part", "fps", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    # Parts of one cell meet once; a tile meets itself as OWN.
    near = near.filter((F.col("to") != F.col("cell")) | (F.col("other") > F.col("part")))
    return near.select(number(F.col("to"), F.col("other")).alias("tile"), F.lit(OTHER).alias("kind"), "fps").union(
        packed.select(number(F.col("cell"), F.col("part")).alias("tile"), F.lit(OWN).alias("kind"), "fps")
    )


def links(fps: DataFrame, radius: int = RADIUS, size: int = TILE) -> DataFrame:
    """Spanning links (a, b) among the distinct longs of ``fps.fp``."""
    dealt = tiles(fps, radius, size).repartition("tile").sortWithinPartitions("tile", "kind")
    return dealt.mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def _grouped(docs: DataFrame, radius: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint of each row of (doc_id, t1, text), and (fp, root, component_id) of each fingerprint."""
    ensure_checkpoint_dir(docs.sparkSession)
    marked = _fingerprints(docs, shingle).checkpoint()
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = counted_apart(rooted, ["root"], F.min("least").alias("component_id"))
    return marked, rooted.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``."""
    rows = id_and_text(docs, id_col, text_col).select("doc_id", F.lit(0).cast("long").alias("t1"), "text")
    marked, named = _grouped(rows, radius, shingle)
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    """16 lowercase hex digits of a fingerprint held as a signed long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` from each group, with its own columns only: the one of the smallest id.

    Rows that share that id are told apart by their text's hash, the smallest staying; equal rows
    are one.
    """
    text, key = F.col(quoted(text_col)), F.col(quoted(id_col))
    rows = docs.select(key.alias("doc_id"), F.xxhash64(text).alias("t1"), text.alias("text"))
    marked, named = _grouped(rows, radius, shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1"))
    chosen = marked.join(named.select("fp", "root"), "fp").groupBy("root").agg(first.alias("c")).select("c.doc_id", "c.t1").distinct()
    whole = docs.select(key.alias("kept_id"), F.xxhash64(text).alias("kept_t1"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"))
    kept = whole.join(chosen, F.col("kept_id").eqNullSafe(F.col("doc_id")) & (F.col("kept_t1") == F.col("t1")), "left_semi")
    return kept.dropDuplicates(["kept_id", "kept_t1"]).select("doc.*")
