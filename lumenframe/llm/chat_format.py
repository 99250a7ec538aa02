"""Multi-party perspective rotation.

Each participant of a conversation gets a rendering of the whole dialogue in which they are the
assistant and every other speaker is a named user. The loss mask covers just the assistant's
contents and the mark that ends each of them. System turns stay system turns, never trained on,
in every perspective.

A turn is ``<|start|>ROLE[ name=NAME]\\nCONTENT<|end|>\\n``. A conversation is rendered in parts of
``part_turns`` turn numbers: part p holds turns p * part_turns up to the next. Most have one part;
a conversation of millions of turns has many. A part with more rows than turn numbers (numbers that come
again, or that are all null) is cut into pieces of about ``part_turns`` rows, so no task holds a
conversation, a part or a turn number whole. Pieces follow one another in the order of the part: a row's place is
the number of rows with smaller turn numbers, and among those of its own number what its hash says.
A piece's turns are grouped, its participants joined on, and rendered by array expressions.

Defined results: turns with equal numbers are ordered by the MD5 of role and text; repeated rows (all four
columns equal) are one turn; turn numbers that are null or no whole numbers form a part of their own, -1, which comes
first; a null or empty role is the speaker "unknown", a null text is empty; a very long text stays whole in its turn; a
null conv_id is a conversation of its own; conversations with only system turns have no participant and so no
rendering; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.words import quoted

PART_TURNS = 256
SYSTEM = ("system",)
START, END = "<|start|>", "<|end|>\n"


def _rendered(turns: str, speaker: Column) -> Column:
    """Each turn as struct (text, head: length of what stands before the content, own: is it masked in)."""

    def one(t: Column) -> Column:
        own = t["role"] == speaker
        head = F.when(own, F.lit("assistant")).when(t["role"].isin(*SYSTEM), F.lit("system")).otherwise(F.concat(F.lit("user name="), t["role"]))
        head = F.concat(F.lit(START), head, F.lit("\n"))
        return F.struct(F.concat(head, t["text"], F.lit(END)).alias("text"), F.length(head).alias("head"), own.alias("own"))

    return F.transform(turns, one)


def _in_pieces(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``piece``: 0 but in parts of more than ``most`` distinct rows."""
    numbers = rows.select("conv_id", "part", "turn", "hash").distinct().groupBy("conv_id", "part", "turn").agg(F.count("*").alias("n"))
    # A part has at most part_turns turn numbers, so these windows are small.
    whole, before = Window.partitionBy("conv_id", "part"), Window.partitionBy("conv_id", "part").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    full = numbers.withColumn("total", F.sum("n").over(whole)).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("total") > most)
    full = full.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "n", "start")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))
    share = F.conv(F.substring("hash", 1, 8), 16, 10).cast("double") / (1 << 32)
    place = F.col("start") + F.floor(share * F.col("n"))
    return rows.join(full, same, "left").withColumn("piece", F.coalesce(F.floor(place / most), F.lit(0)).cast("long")).drop("c", "t", "n", "start")


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS
) -> DataFrame:
    """(conv_id, speaker, part, piece, n_turns, n_own, text, mask, spans): ``mask`` has a 0 or 1 for each
    turn, ``spans`` the ranges of characters of ``text`` to train on."""
    role = F.coalesce(F.when(F.col(quoted(role_col)) != "", F.col(quoted(role_col))), F.lit("unknown"))
    rows = turns.select(
        F.col(quoted(conv_col)).alias("conv_id"), F.col(quoted(turn_col)).try_cast("long").alias("turn"), role.alias("role"),
        F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"),
    )
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long")
    rows = rows.withColumn("part", part).withColumn("hash", F.md5(F.concat("role", F.lit("\n"), "text").cast("binary")))
    rows = _in_pieces(rows, part_turns)
    said = F.array_sort(F.collect_set(F.struct("turn", "hash", "role", "text")))
    parts = rows.groupBy("conv_id", "part", "piece").agg(said.alias("turns"))
    speakers = rows.filter(~F.col("role").isin(*SYSTEM)).select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    each = parts.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select(
        "conv_id", "speaker", "part", "piece", _rendered("turns", F.col("speaker")).alias("turns")
    )
    # Where each turn starts: a running sum of lengths; a part's length is bounded.
    starts = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["text"])).alias("at"),
            F.when(
                t["own"],
                F.concat(s["spans"], F.array(F.struct((s["at"] + t["head"]).alias("start"), (s["at"] + F.length(t["text"]) - 1).alias("end")))),
            ).otherwise(s["spans"]).alias("spans"),
        ),
        lambda s: s["spans"],
    )
    return each.select(
        "conv_id", "speaker", "part", "piece", F.size("turns").cast("long").alias("n_turns"), F.size(F.filter("turns", lambda t: t["own"])).cast("long").alias("n_own"),
        F.array_join(F.transform("turns", lambda t: t["text"]), "").alias("text"),
        F.array_join(F.transform("turns", lambda t: F.when(t["own"], "1").otherwise("0")), "").alias("mask"), starts.alias("spans"),
    )
