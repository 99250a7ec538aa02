r"""Benchmark decontamination with suffix arrays over the training text.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. A window is ``window``
consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A
document word inside any occurrence of a window is hit.

The training text is cut into shards of whole documents. Of each, the suffixes that could reach the shortest
window (a word that no item has ends a suffix) are sorted whole, by prefix doubling, and every suffix of
every item is looked up by binary search. The training suffixes next to where it falls share its longest
verbatim match; from there the run of suffixes on both sides that share a window gives all the places. Each match
is as long as both texts agree.

A benchmark of at most ``most_bytes`` of text, which is checked first, is sent to every task, and each Arrow batch
of documents is a shard: nothing is shuffled. A larger one is never collected: documents are dealt into
shards of about ``shard_bytes`` of text, the items are sent to each shard as rows, and a task holds one shard and
one batch of items at a time. Both ways run the same search in one MapInArrow.

Defined results: null and empty texts have no words and are clean; items without words have no
window; rows of one item_id are one item, and a null item_id counts as the item "" (empty);
repeated documents are judged row by row; a very long text is a shard of its own; an empty benchmark leaves all
clean; an empty table gives no rows; of equally long matches with an item the first place stays; other columns are
not read, and ``remove_contaminated`` returns them untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from lumenframe.llm.words import alnum_words, quoted

WINDOW = 13
#: Bytes of benchmark text that are sent to every task; a larger benchmark is sent to shards.
MOST_BYTES = 4 << 20
#: Bytes of documents in a shard of the other way.
SHARD_BYTES = 16 << 20
#: Words of one suffix array; a larger batch is cut between documents.
SHARD_WORDS = 1 << 21
#: Words that two suffixes are compared by at a time.
STEP = 16

KINDS = (
    pa.int64(),
    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    pa.list_(pa.string()),
    pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])),
)
RESULT = T.StructType([T.StructField(n, from_arrow_type(k)) for n, k in zip(("n_words", "spans", "items", "matches"), KINDS)])


class Queries:
    """Items as word codes, one after the other, each followed by -2; all their suffixes are looked up."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.window = window
        self.codes: dict[bytes, int] = {}
        self.ids = sorted({i or "" for i, _ in items})
        place = {x: n for n, x in enumerate(self.ids)}
        coded = [[self.codes.setdefault(w, len(self.codes)) for w in alnum_words(text)] for _, text in items]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        offset = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.words = np.full(offset[-1] + STEP, -2, np.int32)
        for at, words in zip(offset.tolist(), coded):
            self.words[at : at + len(words)] = words
        # Suffixes that hold a window: of a short item the whole only.
        size = np.minimum(lengths, window)
        counts = np.where(lengths > 0, lengths - size + 1, 0)
        of = np.repeat(np.arange(len(coded)), counts)
        self.start = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int64)
        self.at = offset[of] + self.start
        self.least = size[of]
        self.owner = np.array([place[i or ""] for i, _ in items], np.int64)[of] if len(of) else np.empty(0, np.int64)
        self.shortest = int(self.least.min()) if len(of) else window


def suffix_array(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` sorted by all the codes that follow each, by prefix doubling; after each doubling only
    suffixes that are still alike are sorted again. Places from the end on count as -1."""
    n = len(codes)
    _, rank = np.unique(codes, return_inverse=True)
    # A rank is the number of suffixes before those alike, so ranks of parts can be refined alone.
    rank = np.concatenate(([0], np.cumsum(np.bincount(rank))))[rank] + 1
    alike = np.arange(n)
    span = 1
    while span < n:
        order = np.argsort(rank[alike], kind="stable")
        alike = alike[order]
        first = rank[alike]
        size = np.diff(np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1], [True]))))
        alike = alike[np.repeat(size > 1, size)]
        if not alike.size:
            break
        ahead = alike + span
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], 0)
        order = np.lexsort((key, rank[alike]))
        alike, key = alike[order], key[order]
        first = rank[alike]
        fresh = np.concatenate(([True], first[1:] != first[:-1]))
        new = fresh | np.concatenate(([True], key[1:] != key[:-1]))
        at = np.arange(len(alike))
        group, part = np.maximum.accumulate(np.where(fresh, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[alike] = first + part - group
        span *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def shared_words(codes: np.ndarray, at: np.ndarray, words: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words the suffixes ``at`` of ``codes`` share with those ``where`` of ``words``, and whether
    they sort before them."""
    shared, before = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    open_, span = np.arange(len(at)), np.arange(STEP)
    while open_.size:
        a = codes[np.minimum(at[open_] + shared[open_], len(codes) - STEP)[:, None] + span]
        b = words[np.minimum(where[open_] + shared[open_], len(words) - STEP)[:, None] + span]
        differ = a != b
        first = np.argmax(differ, axis=1)
        ended = differ[np.arange(len(open_)), first]
        shared[open_] += np.where(ended, first, STEP)
        before[open_[ended]] = (a < b)[ended, first[ended]]
        open_ = open_[~ended]
    return shared, before


def search(codes: np.ndarray, array: np.ndarray, words: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Where in the suffix array each of the suffixes ``where`` of ``words`` falls, by binary search of all at once."""
    low, high = np.zeros(len(where), np.int64), np.full(len(where), len(array), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        _, before = shared_words(codes, array[mid], words, where[open_])
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)
    return low


def _extent(codes: np.ndarray, array: np.ndarray, q: Queries, which: np.ndarray, low: np.ndarray, step: int) -> np.ndarray:
    """How many suffixes in a row, from ``low`` on (or before it, for a ``step`` of -1), share enough words with each
    query. Away from where a query falls the words shared only become fewer, so this too is a binary search."""
    some = np.zeros(len(which), np.int64)
    most = low.copy() if step < 0 else len(array) - low
    while (open_ := np.flatnonzero(some < most)).size:
        mid = (some[open_] + most[open_] + 1) // 2
        at = low[open_] - mid if step < 0 else low[open_] + mid - 1
        shared, _ = shared_words(codes, array[at], q.words, q.at[which[open_]])
        enough = shared >= q.least[which[open_]]
        some[open_] = np.where(enough, mid, some[open_])
        most[open_] = np.where(enough, most[open_], mid - 1)
    return some


def occurrences(codes: np.ndarray, array: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix of an item, place in ``codes``, words shared) wherever a window of an item stands."""
    low = search(codes, array, q.words, q.at)
    near = np.zeros(len(low), np.int64)
    for at in (low - 1, low):
        inside = np.flatnonzero((at >= 0) & (at < len(array)))
        near[inside] = np.maximum(near[inside], shared_words(codes, array[at[inside]], q.words, q.at[inside])[0])
    which = np.flatnonzero(near >= q.least)
    before, after = (_extent(codes, array, q, which, low[which], step) for step in (-1, 1))
    of, at = _expand(low[which] - before, low[which] + after)
    place, which = array[at], which[of]
    return which, place, shared_words(codes, place, q.words, q.at[which])[0]


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of every range, with the range it is from."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return which, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[which]


def _runs(begin: np.ndarray, end: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first row, and the furthest end, of each run of touching spans; rows sorted by
    (same, begin), with ends that never fall inside a run of equal ``same``."""
    new = np.concatenate(([True], (same[1:] != same[:-1]) | (begin[1:] > end[:-1])))
    first = np.flatnonzero(new)
    return first, np.maximum.reduceat(end, first)


def shard_matches(docs: list[list[bytes]], q: Queries) -> list[tuple[list, list, list]]:
    """For each document of one shard: hit spans, item ids, and each item's longest match."""
    lengths = np.fromiter(map(len, docs), np.int64, len(docs))
    empty: list[tuple[list, list, list]] = [([], [], []) for _ in docs]
    if not len(q.at) or not lengths.sum():
        return empty
    # A document is followed by one -1, which no item holds.
    offset = np.concatenate(([0], np.cumsum(lengths + 1)))
    codes = np.full(offset[-1], -1, np.int32)
    lookup = q.codes.get
    for i, words in enumerate(docs):
        codes[offset[i] : offset[i] + len(words)] = [lookup(w, -1) for w in words]
    # Only stretches of known words that could hold the shortest window stay, each with its -1.
    stops = np.flatnonzero(codes < 0)
    room = np.diff(np.concatenate(([-1], stops))) - 1
    lasting = np.flatnonzero(room >= q.shortest)
    if not lasting.size:
        return empty
    _, origin = _expand(stops[lasting] - room[lasting], stops[lasting] + 1)
    near = codes[origin]
    left = np.repeat(stops[lasting], room[lasting] + 1) - origin
    array = suffix_array(near, np.flatnonzero(left >= q.shortest))
    which, place, length = occurrences(np.concatenate([near, np.full(STEP, -1, np.int32)]), array, q)
    if not which.size:
        return empty
    where = origin[place]
    doc = np.searchsorted(offset, where, side="right") - 1
    begin, owner, start = where - offset[doc], q.owner[which], q.start[which]
    # Hit words of each document: every word of a match lies in a window of it, and touching spans merge.
    order = np.lexsort((begin, doc))
    d, b, e = doc[order], begin[order], (begin + length)[order]
    far = int(lengths.max()) + 1
    reach = np.maximum.accumulate(e + d * far) - d * far
    first, ends = _runs(b, reach, d)
    for i, x, y in zip(d[first].tolist(), b[first].tolist(), ends.tolist()):
        empty[i][0].append((x, y))
    # The longest match of each item, the first place of equals.
    best = np.lexsort((start, begin, -length, owner, doc))
    d, o, b, s, n = doc[best], owner[best], begin[best], start[best], length[best]
    top = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (o[1:] != o[:-1]))))
    for i, item, x, y, z in zip(*(v[top].tolist() for v in (d, o, s, b, n))):
        empty[i][1].append(q.ids[item])
        empty[i][2].append({"item_id": q.ids[item], "item_start": x, "doc_start": y, "length": z})
    return empty


def _shards(texts: list[str | None], most: int) -> Iterator[list[list[bytes]]]:
    docs, words = [], 0
    for text in texts:
        docs.append(alnum_words(text))
        words += len(docs[-1])
        if words >= most:
            yield docs
            docs, words = [], 0
    yield docs


def _merge(old: tuple[list, list, list], new: tuple[list, list, list]) -> tuple[list, list, list]:
    """Results of one document against two sets of items; items of both keep the longer match."""
    if not old[1] or not new[1]:
        return new if new[1] else old
    spans: list[tuple[int, int]] = []
    for start, end in sorted(old[0] + new[0]):
        if spans and start <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], end)
        else:
            spans.append((start, end))
    best: dict[str, dict] = {}
    for m in sorted(old[2] + new[2], key=lambda m: (m["item_id"], -m["length"], m["doc_start"], m["item_start"])):
        best.setdefault(m["item_id"], m)
    return spans, list(best), list(best.values())


def _result(doc: pa.Array, counts: list[int], found: list[tuple[list, list, list]]) -> pa.RecordBatch:
    spans = [[{"start": a, "end": b} for a, b in f[0]] for f in found]
    columns = [counts, spans, [f[1] for f in found], [f[2] for f in found]]
    return pa.RecordBatch.from_arrays([doc, *(pa.array(c, k) for c, k in zip(columns, KINDS))], names=["doc", *RESULT.names])


def _sent(rows: DataFrame, items: list[tuple[str | None, str | None]], window: int) -> DataFrame:
    """``rows`` (doc) with results against items that every task holds."""
    sent = rows.sparkSession.sparkContext.broadcast(items)
    at = rows.schema["doc"].metadata["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = Queries(sent.value, window)
        for batch in batches:
            counts, found = [], []
            for docs in _shards(batch.column(0).field(at).to_pylist(), SHARD_WORDS):
                counts += map(len, docs)
                found += shard_matches(docs, q)
            yield _result(batch.column(0), counts, found)

    return rows.mapInArrow(run, T.StructType([rows.schema["doc"], *RESULT.fields]))


def _dealt(rows: DataFrame, items: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """The same with documents dealt into shards, to each of which all items go as rows."""
    field = rows.schema["doc"].dataType.fields[rows.schema["doc"].metadata["text"]].name
    text = F.col("doc")[field]
    total = rows.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    item = T.StructType([T.StructField("item_id", T.StringType()), T.StructField("text", T.StringType())])
    # Copies of a row are spread by the partition they are read from; maps have no hash.
    hashed = [F.col("doc")[f.name] for f in rows.schema["doc"].dataType.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    docs = rows.select(F.pmod(F.xxhash64(*hashed, F.spark_partition_id()), F.lit(shards)).alias("shard"), F.lit(0).alias("kind"), "doc", F.lit(None).cast(item).alias("item"))
    queries = items.select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.lit(1).alias("kind"),
        F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"), F.struct("item_id", "text").alias("item"),
    )
    at = rows.schema["doc"].metadata["text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, words, found = None, [], [], []

        def close() -> Iterator[pa.RecordBatch]:
            done = 0
            for part in held:
                size = len(part)
                yield _result(part, list(map(len, words[done : done + size])), found[done : done + size])
                done += size

        for batch in batches:
            numbers, kinds = (batch.column(i).to_numpy() for i in (0, 1))
            edges = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)]):
                if start == end:
                    continue
                if numbers[start] != shard:
                    yield from close()
                    shard, held, words, found = numbers[start], [], [], []
                if kinds[start] == 0:
                    part = batch.column(2).slice(start, end - start)
                    held.append(part)
                    words += map(alnum_words, part.field(at).to_pylist())
                    found += [([], [], [])] * len(part)
                elif words:
                    q = Queries([(r["item_id"], r["text"]) for r in batch.column(3).slice(start, end - start).to_pylist()], window)
                    new: list[tuple[list, list, list]] = []
                    while len(new) < len(words):
                        piece, size = [], 0
                        while len(new) + len(piece) < len(words) and size < SHARD_WORDS:
                            piece.append(words[len(new) + len(piece)])
                            size += len(piece[-1])
                        new += shard_matches(piece, q)
                    found = [_merge(a, b) for a, b in zip(found, new)]
        yield from close()

    both = docs.unionByName(queries).repartition("shard").sortWithinPartitions("shard", "kind")
    return both.mapInArrow(run, T.StructType([rows.schema["doc"], *RESULT.fields]))


def _all_matches(rows: DataFrame, benchmark: DataFrame, window: int, most_bytes: int, shard_bytes: int) -> DataFrame:
    """``rows`` (doc) with the results against all items; of the benchmark no more than ``most_bytes`` is collected."""
    items = benchmark.select(F.col(quoted("item_id")).cast("string").alias("item_id"), F.col(quoted("text")).alias("text"))
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 16)).first()[0] or 0
    if size <= most_bytes:
        return _sent(rows, [tuple(r) for r in items.collect()], window)
    return _dealt(rows, items, window, shard_bytes)


def _doc(columns: list[tuple[str, str]], text: str) -> Column:
    """The named columns as one struct, whose metadata tells which field is the text."""
    names = [name for name, _ in columns]
    return F.struct(*[F.col(quoted(c)).alias(name) for name, c in columns]).alias("doc", metadata={"text": names.index(text)})


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(doc_id, n_words, spans, items, matches): hit spans of words, the items met, and the longest
    verbatim match of each with its places; one row per row of ``docs``."""
    rows = docs.select(_doc([("doc_id", id_col), ("text", text_col)], "text"))
    return _all_matches(rows, benchmark, window, most_bytes, shard_bytes).select("doc.doc_id", "n_words", "spans", "items", "matches")


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))


def is_contaminated() -> Column:
    """A hit, and a twentieth of the words or more hit."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns only."""
    rows = docs.select(_doc([(c, c) for c in docs.columns], text_col))
    return _all_matches(rows, benchmark, window, most_bytes, shard_bytes).filter(~is_contaminated()).select("doc.*")
