"""Jump consistent hashing (Lamping and Veach, 2014): stable keys to shards, no ring table.

Each key draws pseudo-random jumps from its own linear congruential generator; the shard is
the last jump below the shard count. Appending a shard moves only keys whose next jump lands
in it. All of it is column expressions: the 64-bit generator is kept as two 32-bit halves
because Spark's multiplication of longs raises on overflow instead of wrapping.

Slots number the rows of a shard from 0 without gaps. No task ever ranks a whole shard: equal
(id, size, checksum) rows are counted first, those counts are ranked inside hashed bins of a
bounded size, and bins start where the previous ones of the shard end.

Defined results: an id that is no whole number is hashed by its text (XXH64), a null one is key 0, and comes
back as null; a null text has size 1 and checksum 0, as an empty one, and a very long one counts whole; repeated
rows share a shard and take neighbouring slots, in pieces of a bounded size; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.lineage import ensure_checkpoint_dir
from lumenframe.llm.words import id_and_text, quoted

#: Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
LOW = 0xFFFFFFFF
#: Jumps unrolled before the exact, slower fallback; the expected number is ln(shards) + 1.
USUAL_JUMPS = 48
#: Distinct rows that one bin of a shard holds on average.
BIN_ROWS = 20_000
#: Equal rows that are numbered at a time.
PIECE_ROWS = 4096


def _times(half: Column, factor: int) -> Column:
    """Low 32 bits of ``half * factor``; both factors below 2**32, no step reaches 2**63."""
    low, high = factor & 0xFFFF, factor >> 16
    return (half * low + F.shiftleft((half * high).bitwiseAND(0xFFFF), 16)).bitwiseAND(LOW)


def _advance(high: Column, low: Column) -> tuple[Column, Column]:
    """Halves of ``key * MULTIPLIER + 1`` modulo 2**64."""
    factor_low, factor_high = MULTIPLIER & LOW, MULTIPLIER >> 32
    part0, part1 = low * (factor_low & 0xFFFF) + 1, low * (factor_low >> 16)
    under = part0 + F.shiftleft(part1.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(under, 32) + F.shiftright(part1, 16)
    return (carry + _times(high, factor_low) + _times(low, factor_high)).bitwiseAND(LOW), under.bitwiseAND(LOW)


def _jumps(key: Column, shards: list[int], most: int) -> Column:
    """State after ``most`` jumps: the last jump below each shard count, and the next jump."""
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    names = [f"b{n}" for n in shards]
    zero = F.struct(
        F.shiftrightunsigned(key, 32).alias("high"), key.bitwiseAND(LOW).alias("low"), F.lit(0).cast("long").alias("jump"),
        *[F.lit(-1).cast("long").alias(b) for b in names],
    )

    def step(state: Column, _: Column) -> Column:
        high, low = _advance(state["high"], state["low"])
        # The next jump is floor((b + 1) * 2**31 / (top 31 bits + 1)) with b this jump.
        at = state["jump"]
        onward = F.floor((at + 1).cast("double") * (F.lit(2147483648.0) / (F.shiftright(high, 1) + 1).cast("double")))
        past = at >= max(shards)
        return F.struct(
            F.when(past, state["high"]).otherwise(high).alias("high"), F.when(past, state["low"]).otherwise(low).alias("low"),
            F.when(past, at).otherwise(onward.cast("long")).alias("jump"),
            *[F.when(at < n, at).otherwise(state[b]).alias(b) for n, b in zip(shards, names)],
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), zero, step)


def jump_shards(key: Column, shards: list[int]) -> Column:
    """Struct with field ``b<n>`` for each shard count ``n``: the shard of ``key`` among n.

    A jump is at least one further than the last, so ``max(shards)`` jumps always suffice;
    keys that need more than ``USUAL_JUMPS`` of them are finished by the full number.
    """
    if min(shards) < 1:
        raise ValueError("a shard count must be 1 or more")
    most = max(shards)
    state = _jumps(key, shards, min(most, USUAL_JUMPS))
    if most > USUAL_JUMPS:
        state = F.when(state["jump"] < most, _jumps(key, shards, most)).otherwise(state)
    return F.struct(*[state[f"b{n}"].cast("int").alias(f"b{n}") for n in shards])


def key_of(df: DataFrame, id_col: str) -> Column:
    """The 64-bit key of an id: whole numbers are their own, anything else is hashed by its text; null is 0."""
    whole = df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    key = F.col(quoted(id_col)).cast("long") if whole else F.when(F.col(quoted(id_col)).isNotNull(), F.xxhash64(F.col(quoted(id_col)).cast("string")))
    return F.coalesce(key, F.lit(0).cast("long"))


def assign(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", bin_rows: int = BIN_ROWS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard (with one more shard) and slot.

    The texts are read once and stay in the scan's stage: only sizes, checksums and counts go on.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    key = ["doc_id", "size", "text_crc32"]
    counted = rows.groupBy(*key).agg(F.count("*").alias("n"))
    state = jump_shards(key_of(counted, "doc_id"), [n_shards, n_shards + 1])
    placed = counted.withColumn("s", state).select(
        *key, "n", F.col(f"s.b{n_shards}").alias("shard"), F.col(f"s.b{n_shards + 1}").alias("grown_shard")
    ).checkpoint()
    bins = max(1, -(-placed.count() // (n_shards * bin_rows)))
    placed = placed.withColumn("bin", F.pmod(F.xxhash64(*key), F.lit(bins)).cast("long"))
    in_shard = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy("shard", "bin").agg(F.sum("n").alias("rows"))
        .select("shard", "bin", F.coalesce(F.sum("rows").over(in_shard), F.lit(0)).alias("start"))
    )
    in_bin = Window.partitionBy("shard", "bin").orderBy(*[F.col(k).asc_nulls_first() for k in key])
    ranked = placed.withColumn("before", F.coalesce(F.sum("n").over(in_bin.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    located = ranked.join(starts, ["shard", "bin"]).withColumn("first", F.col("start") + F.col("before"))
    # Equal rows take their slots in pieces, which are dealt apart: no array is longer than a piece.
    pieces = located.select(*key, "shard", "grown_shard", "first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(piece_rows).cast("long"))).alias("at"))
    pieces = pieces.repartition(*key, "at")
    last = F.least(F.col("at") + piece_rows, F.col("n")) - 1
    return pieces.select(*key, "shard", "grown_shard", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + last)).alias("slot"))
