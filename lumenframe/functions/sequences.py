"""Column expressions over label and token sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(v: Column) -> Column:
    """Index of the largest element, the first of equals."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def ctc_collapsed(labels: Column) -> Column:
    """Labels without repeats of the one before and without blanks, 0."""
    last = F.concat(F.array(F.lit(-1)), labels)
    keep = F.filter(F.arrays_zip(labels.alias("l"), last.alias("p")), lambda z: (z["l"] != z["p"]) & (z["l"] != 0) & z["l"].isNotNull())
    return F.transform(keep, lambda z: z["l"])


def ctc_text(labels: Column, charset: str) -> Column:
    """Greedy CTC text: class i is the charset's i-th character; others are left out."""
    known = F.filter(ctc_collapsed(labels), lambda i: i.between(1, len(charset)))
    return F.array_join(F.transform(known, lambda i: F.substring(F.lit(charset), i, F.lit(1))), "")


def penalised(logits: Column, generated: Column, penalty: float = 1.5, window: int = 8, exempt: tuple[int, ...] = ()) -> Column:
    """Logits of tokens among the last ``window`` generated divided by ``penalty``."""
    recent = F.when(F.size(generated) > window, F.slice(generated, -window, window)).otherwise(generated)
    hit = lambda i: F.array_contains(recent, i) & ~i.isin(*exempt) if exempt else F.array_contains(recent, i)
    return F.transform(logits, lambda v, i: F.when(hit(i), v / penalty).otherwise(v))
