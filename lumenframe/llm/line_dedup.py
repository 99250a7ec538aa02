r"""Line dedup by overlapping three-line windows.

Lines are the \n-split pieces of a text that hold a character other than the six ASCII spaces;
blank ones are skipped by the windows and always stay. Every run of three consecutive lines is
hashed (128 bits over the exact lines). A window whose hash occurs earlier, in the order of
(doc_id, text hash, position), is a later occurrence; the lines that later occurrences cover are
merged and removed. A line that goes always has an equal line at an earlier place, so the first
copy of everything stays.

Defined results: null and empty texts come back as they are; texts of one or two lines have no
window and stay; a very long text is cut and hashed whole, and put together again in one task; null ids sort first; rows
repeated with equal id and text are one occurrence and all stay or change alike; an empty table gives no rows; other columns pass through
``dedup_documents`` untouched, whatever their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.words import counted_apart, id_and_text, quoted

WINDOW = 3
#: A line with anything but the six ASCII spaces.
_HAS_WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t1, at, w1, w2): each window's first line, counted among lines with a word, and hash."""
    worded = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(_HAS_WORD))
    lines = docs.select("doc_id", F.xxhash64("text").alias("t1"), worded.alias("lines"))
    each = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (window - 1)),
        lambda i: F.struct(
            (i - 1).alias("at"),
            F.xxhash64(*[F.element_at("lines", i + k) for k in range(window)]).alias("w1"),
            F.xxhash64(*[F.element_at("lines", i + k) for k in reversed(range(window))], F.lit(window)).alias("w2"),
        ),
    )
    return lines.select("doc_id", "t1", F.inline(F.when(F.size("lines") >= window, each)))


def removed_lines(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t1, gone): sorted indexes, among the lines with a word, that later windows cover.

    Hashes are counted with map-side sums before the shuffle; only hashes found twice are
    joined back, and that join may be split where one window is very common.
    """
    found = windows(docs, window)
    place = F.struct("doc_id", "t1", "at")
    repeated = counted_apart(found, ["w1", "w2"], F.min(place).alias("first"), F.max(place).alias("last"))
    repeated = repeated.filter("first < last").select("w1", "w2", "first")
    later = found.join(repeated, ["w1", "w2"]).filter(place > F.col("first"))
    covered = later.groupBy("doc_id", "t1").agg(F.collect_set("at").alias("starts"))
    spread = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1)))
    return covered.select("doc_id", "t1", F.array_sort(F.array_distinct(spread)).alias("gone"))


def _kept_text(texts: pd.Series, gone: pd.Series) -> pd.Series:
    """Texts without the lines whose index among the lines with a word is in ``gone``; null stays null."""
    return pd.Series([None if t is None else _without(t, set(g)) for t, g in zip(texts, gone)], dtype=object)


def _without(text: str, gone: set[int]) -> str:
    kept, at = [], -1
    for line in text.split("\n"):
        worded = bool(line.strip(SPACES))
        at += worded
        if not (worded and at in gone):
            kept.append(line)
    return "\n".join(kept)


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, count_col: str | None = "lines_removed") -> DataFrame:
    """``docs`` with the text shortened; all rows and other columns stay. ``count_col`` is added with the
    number of lines removed (None: no such column), with underscores behind its name where ``docs`` has that already.

    Only texts that change go through Python.
    """
    while count_col and count_col.lower() in {c.lower() for c in docs.columns}:
        count_col += "_"
    text = F.col(quoted(text_col))
    whole = docs.select(F.col(quoted(id_col)).alias("doc_id"), F.xxhash64(text).alias("t1"), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"))
    gone = removed_lines(id_and_text(docs, id_col, text_col), window)
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("t1").alias("gone_t1"), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("t1") == F.col("gone_t1"))
    changed = F.col("gone").isNotNull()
    both = whole.join(gone, same, "left").withColumn("new", F.pandas_udf(_kept_text, "string")(F.when(changed, F.col("doc")[text_col]), "gone"))
    fields = [
        (F.when(changed, F.col("new")).otherwise(F.col("doc")[c]) if c == text_col else F.col("doc")[c]).alias(c)
        for c in docs.columns
    ]
    count = [F.when(changed, F.size("gone")).otherwise(0).cast("long").alias(count_col)] if count_col else []
    return both.select(*fields, *count)
