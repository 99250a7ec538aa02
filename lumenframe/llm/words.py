"""Words of a text as UTF-8 bytes, split by exact byte sets.

UTF-8 never uses bytes below 0x80 inside a longer character, so splitting the encoded
text at ASCII bytes gives the same words as a pattern over code points would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower-cases A-Z and turns every other ASCII byte than 0-9 and a-z into a space.
_ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def space_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+``: ``bytes.split`` cuts at just these six bytes. Null has none."""
    return text.encode().split() if text else []


def alnum_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z. Null has none."""
    return text.encode().translate(_ALNUM).split() if text else []


def quoted(name: str) -> str:
    """A column name that may hold dots or backticks, as a reference to that one column."""
    return "`" + name.replace("`", "``") + "`"


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads; other columns can then never clash with its own."""
    return docs.select(F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(text_col)).alias("text"))


def counted_apart(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """``df`` summed up by long keys, for a join back on them.

    The keys are grouped in another form than the one they come back in. Else the join would take
    over the aggregate's partitioning, and Spark splits a skewed join only where both of its sides
    were dealt for it.
    """
    hidden = [F.bitwise_not(F.col(k)).alias(f"_{k}") for k in keys]
    found = df.groupBy(*hidden).agg(*aggregates)
    return found.select(*[F.bitwise_not(F.col(f"_{k}")).alias(k) for k in keys], *[quoted(c) for c in found.columns[len(keys) :]])


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart where an id may be repeated; null differs from empty."""
    return F.struct(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("#"), text).alias("h2"))
