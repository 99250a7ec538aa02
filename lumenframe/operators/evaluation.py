"""Predictions against labelled data: reconciliation, micro scores, error rates, grids."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text

ENTITIES = {"brand": lexicon.BRAND_ALIASES, "model": lexicon.MODEL_ALIASES}


def reconcile(truth: DataFrame, predictions: DataFrame, key: str = "video_id") -> DataFrame:
    """(key, status): joined, missing (no prediction) or unexpected (no label), by one full join."""
    t, p = (d.select(key).distinct().withColumn(n, F.lit(True)) for d, n in ((truth, "t"), (predictions, "p")))
    status = F.when(F.col("t") & F.col("p"), "joined").when(F.col("t"), "missing").otherwise("unexpected")
    return t.join(p, key, "full").select(key, status.alias("status"))


def set_counts(truth: Column, predicted: Column) -> Column:
    """True positives, false positives and false negatives of two sets."""
    return F.struct(
        F.size(F.array_intersect(truth, predicted)).cast("long").alias("tp"), F.size(F.array_except(predicted, truth)).cast("long").alias("fp"),
        F.size(F.array_except(truth, predicted)).cast("long").alias("fn"),
    )


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """Precision, recall and F1 to four digits, 0 on empty denominators (A10)."""
    p, r = (F.coalesce(F.try_divide(tp, tp + x), F.lit(0.0)) for x in (fp, fn))
    return [F.round(x, 4).alias(n) for x, n in ((p, "precision"), (r, "recall"), (F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), "f1"))]


def entity_sets(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(video_id, entity, t, p) of joined rows: canonical sets of brands, models, years and keywords.

    Both sides have brands, models (arrays of strings), years (array of integers) and keywords (map
    of category to array of strings).
    """
    sides = []
    for side, name in ((truth, "t"), (predictions, "p")):
        plain = [F.struct(F.lit(e).alias("entity"), text.canonical_set(F.col(e + "s"), table).alias("items")) for e, table in ENTITIES.items()]
        years = F.transform(F.coalesce("years", F.array().cast("array<int>")), lambda y: y.cast("string"))
        plain.append(F.struct(F.lit("year").alias("entity"), F.array_sort(F.array_distinct(years)).alias("items")))
        kinds = F.transform(
            F.map_entries(F.coalesce("keywords", F.create_map().cast("map<string,array<string>>"))),
            lambda e: F.struct(F.concat(F.lit("kw:"), e["key"]).alias("entity"), text.canonical_set(e["value"], lexicon.KEYWORD_ALIASES).alias("items")),
        )
        sides.append(side.select("video_id", F.inline(F.concat(F.array(*plain), kinds))).withColumnRenamed("items", name))
    joined = reconcile(truth, predictions).filter("status = 'joined'").select("video_id")
    none = F.array().cast("array<string>")
    both = sides[0].join(sides[1], ["video_id", "entity"], "full").join(joined, "video_id", "left_semi")
    return both.select("video_id", "entity", F.coalesce("t", none).alias("t"), F.coalesce("p", none).alias("p"))


def micro_scores(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(entity, tp, fp, fn, precision, recall, f1) over all joined rows."""
    counts = entity_sets(truth, predictions).select("entity", set_counts(F.col("t"), F.col("p")).alias("c"))
    summed = counts.groupBy("entity").agg(*[F.sum(f"c.{x}").alias(x) for x in ("tp", "fp", "fn")])
    return summed.select("entity", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def misses(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """(video_id, entity, missed, wrong): what each row lacks and has too much, sorted."""
    return entity_sets(truth, predictions).select("video_id", "entity", F.array_sort(F.array_except("t", "p")).alias("missed"), F.array_sort(F.array_except("p", "t")).alias("wrong"))


def edits(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Character edits, and the reference's characters."""
    return F.levenshtein(reference, hypothesis), F.char_length(reference)


#: Code points that letters may have: all but the surrogates, from the space on.
LETTERS = 0x110000 - 0x800 - 0x20


def _as_letters(words: Column, vocabulary: Column) -> Column:
    """One character per word, by its place in the pair's vocabulary."""

    def letter(word: Column) -> Column:
        point = F.array_position(vocabulary, word) + 0x1F
        point = F.when(point < 0xD800, point).otherwise(point + 0x800)
        return F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")

    return F.array_join(F.transform(words, letter), "")


def word_edits(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """Word edits and the reference's words, each distinct word being written as one character.

    Any pair whose edits can be counted at all has fewer distinct words than there are characters; one of more raises.
    """
    r, h = (F.filter(F.split(x, " "), lambda w: w != "") for x in (reference, hypothesis))
    vocabulary = F.array_distinct(F.concat(r, h))
    edits_ = F.levenshtein(_as_letters(r, vocabulary), _as_letters(h, vocabulary))
    return F.when(F.size(vocabulary) <= LETTERS, edits_).otherwise(F.raise_error(F.lit("more distinct words than characters")).cast("int")), F.size(r)


def error_rates(pairs: DataFrame, reference: str = "truth", hypothesis: str = "predicted") -> DataFrame:
    """(mode, n, cer, wer), strict and lenient, over rows whose reference is not blank."""
    rows = pairs.filter(text.stripped(F.coalesce(reference, F.lit(""))) != "")
    modes = F.array(*[
        F.struct(F.lit(name).alias("mode"), f(F.col(reference)).alias("r"), f(F.col(hypothesis)).alias("h"))
        for name, f in (("strict", text.strict_text), ("lenient", text.lenient_text))
    ])
    each = rows.select(F.inline(modes))
    (ce, cn), (we, wn) = edits(F.col("r"), F.col("h")), word_edits(F.col("r"), F.col("h"))
    return each.groupBy("mode").agg(
        F.count("*").alias("n"), F.round(F.sum(ce) / F.sum(cn), 4).alias("cer"), F.round(F.sum(we) / F.sum(wn), 4).alias("wer")
    )


def grid(spark, alphas: tuple[float, ...], betas: tuple[float, ...]) -> DataFrame:
    """Every combination with its tag and place in loop order."""
    combos = [(i, a, b, f"a{a}_b{b}") for i, (a, b) in enumerate((a, b) for a in alphas for b in betas)]
    return spark.createDataFrame(combos, "combo int, alpha double, beta double, tag string")


def ranked_grid(results: DataFrame) -> DataFrame:
    """Results by brand F1, year F1, then error rate; ties in loop order (W5). Missing scores count as worst."""
    score = lambda c, worst: F.coalesce(F.col(c), F.lit(worst))
    return results.orderBy(score("brand_f1", 0.0).desc(), score("year_f1", 0.0).desc(), score("cer", 1.0).asc(), "combo")


def spearman_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation by the t distribution of n - 2 degrees."""
    if n < 3:
        return float("nan")
    if abs(rho) >= 1:
        return 0.0
    dof = n - 2
    t2 = rho * rho * dof / (1 - rho * rho)
    return _incomplete_beta(dof / (dof + t2), dof / 2, 0.5)


def _incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x))
    if x >= (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(1 - x, b, a)
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    total = d
    for m in range(1, 400):
        for even in (True, False):
            if even:
                k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                k = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / ((1 + k * d) or 1e-300)
            c = (1 + k / c) or 1e-300
            total *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * total / a
