"""Quality rules as a bitmask ledger.

Every rule is evaluated once. The ledger keeps, for each document, the measurements and one
bit per failed rule; a policy is a named set of rules, and applying it is one bitwise AND.
Ablations (what a policy would keep without one of its rules) come from counts of the distinct
bit patterns, so no text is read again.

Defined results: a null text has no words and fails ``too_few_words``; an empty text likewise;
a very long text is measured whole, its characters a piece at a time; repeated rows and ties are
measured row by row; an empty table gives an empty ledger; columns
other than the id and the text are not read by the ledger, and ``keep_documents`` returns them
untouched, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm.words import id_and_text, quoted, space_words

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words of one repeat window.
WINDOW = 5
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_adjacent", "n_letters", "n_upper",
)


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements; ``bit`` never changes once given."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_few_words", 0, "n_words < 10"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    Rule("shouting", 4, "n_letters >= 20 AND 100 * n_upper > 50 * n_letters"),
    Rule("stuttering", 5, "n_words >= 10 AND 100 * n_adjacent > 30 * n_words"),
    Rule("long_words", 6, "n_words >= 10 AND word_chars > 40 * n_words"),
)
#: A policy names the rules that reject; new versions are added and old ones stay.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": ("too_few_words", "repeated_windows", "symbol_heavy", "duplicate_lines", "shouting", "stuttering", "long_words"),
}


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: 1 << r.bit for r in rules}
    return sum(bits[name] for name in POLICIES[policy])


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 1 letter, 2 upper case, 4 symbol, 8 space."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))
        if kind[0] == "L":
            table[point] = 3 if kind == "Lu" else 1
    table[[ord(c) for c in SYMBOLS]] = 4
    table[[ord(c) for c in SPACES]] = 8
    return table


def _char_counts(text: str, piece: int = 1 << 20) -> tuple[int, int, int, int]:
    """Code points in words, symbols, letters and upper-case letters, a piece at a time."""
    counts = np.zeros(16, np.int64)
    for at in range(0, len(text), piece):
        points = np.frombuffer(text[at : at + piece].encode("utf-32-le"), np.uint32)
        counts += np.bincount(_classes()[points], minlength=16)
    return int(counts.sum() - counts[8]), int(counts[4]), int(counts[1] + counts[3]), int(counts[3])


def _codes(words: list[bytes]) -> np.ndarray:
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(place.__getitem__, words), np.int64, len(words))


def repeated_word_count(codes: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows found twice or more, the first included.

    Windows get exact ids by joining the ids of shorter ones: no hash, so no collision.
    """
    n = len(codes)
    if n <= window:
        return 0
    ids, span = codes, 1
    while span < window:
        step = min(span, window - span)
        starts = n - span - step + 1
        joined = ids[:starts] * (n + 1) + ids[step : step + starts]
        _, ids, counts = np.unique(joined, return_inverse=True, return_counts=True)
        span += step
        if len(counts) == starts:  # all differ already, so longer ones do
            return 0
    again = np.flatnonzero(counts[ids] > 1)
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, again, 1)
    np.add.at(edges, again + window, -1)
    return int(np.count_nonzero(np.cumsum(edges[:n])))


def measure(text: str | None, words: list[bytes] | None = None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of ``MEASURES``; its words may be given."""
    text = text or ""
    words = space_words(text) if words is None else words
    word_chars, symbols, letters, upper = _char_counts(text)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    codes = _codes(words)
    adjacent = int(np.count_nonzero(codes[1:] == codes[:-1]))
    return (len(words), word_chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_word_count(codes), adjacent, letters, upper)


def _measured(batches: Iterator[pa.RecordBatch], text_col: str, kept: list[str]) -> Iterator[pa.RecordBatch]:
    """Each batch's ``kept`` columns and the measurements of its texts."""
    for batch in batches:
        texts = batch.column(batch.schema.names.index(text_col)).to_pylist()
        rows = np.array([measure(t) for t in texts], np.int64).reshape(-1, len(MEASURES))
        arrays = [batch.column(batch.schema.names.index(k)) for k in kept]
        yield pa.RecordBatch.from_arrays(
            arrays + [pa.array(rows[:, i]) for i in range(len(MEASURES))], names=[*kept, *MEASURES]
        )


def _schema(kept: T.StructField) -> T.StructType:
    return T.StructType([kept, *(T.StructField(m, T.LongType()) for m in MEASURES)])


def fail_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = [F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return total


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``fail_bits``: one row per row of ``docs``, without a shuffle."""
    rows = id_and_text(docs, id_col, text_col)
    measured = rows.mapInArrow(lambda it: _measured(it, "text", ["doc_id"]), _schema(rows.schema["doc_id"]))
    return measured.withColumn("fail_bits", fail_bits(rules))


def apply_policy(rows: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``kept`` from the stored bits."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy, rules))) == 0)


def ablations(rows: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents it fails, documents only it rejects, and how many
    the policy keeps with and without it. Patterns of bits are counted first, so what is
    exploded per rule has at most 2 ** len(rules) rows."""
    mask = policy_mask(policy, rules)
    names = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1])
    patterns = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("pattern")).agg(F.count("*").alias("n"))
    each = patterns.select("pattern", "n", F.explode(names).alias("r")).select("pattern", "n", "r.rule", "r.bit")
    n = F.col("n")
    return (
        each.groupBy("rule")
        .agg(
            F.sum(F.when(F.col("pattern").bitwiseAND(F.col("bit")) != 0, n).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("pattern") == F.col("bit"), n).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("pattern") == 0, n).otherwise(0)).alias("n_kept"),
        )
        .withColumn("n_kept_without", F.col("n_kept") + F.col("n_only"))
    )


def keep_documents(docs: DataFrame, policy: str = "v1", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with their own columns only."""
    whole = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("doc"), F.col(quoted(text_col)).alias("text"))
    measured = whole.mapInArrow(lambda it: _measured(it, "text", ["doc"]), _schema(whole.schema["doc"]))
    measured = measured.withColumn("fail_bits", fail_bits(rules))
    return apply_policy(measured, policy, rules).filter("kept").select("doc.*")
