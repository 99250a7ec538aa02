"""Which labelled rows a model may learn from, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Remainders of crc32(id as text) modulo this; 0 is held out.
FOLDS = 5


def held_out(doc_id: str = "doc_id") -> Column:
    """True for rows that no model learns from. A null id counts as the empty text: held out."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def training_sample(labels: DataFrame, label: str, per_label: int) -> DataFrame:
    """(doc_id, y): at most ``per_label`` rows of each label 0 and 1, of those not held out.

    They are the rows of the smallest hash of their id: a sample that does not hang on row order.
    Ids with two different labels are left out.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & ~held_out())
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).filter("y = most").drop("most")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    return rows.filter("y = 0").orderBy(*order).limit(per_label).union(rows.filter("y = 1").orderBy(*order).limit(per_label))
