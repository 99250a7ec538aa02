"""Entities and corrections in recognised text, where the similarity is difflib's ratio.

Distinct words are matched once: texts are split into words natively, each distinct word or run
of words is compared with the vocabulary in Arrow batches behind exact bounds on its length, and
the matches are joined back. The ratio itself has no built-in form.
"""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text
from lumenframe.lineage import materialised

RATIO = 0.85
VOCABULARIES = {"brand": lexicon.BRANDS, "model": lexicon.MODELS} | {f"keyword_{k}": v for k, v in lexicon.KEYWORDS.items()}


def ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's similarity; the order of the two matters."""
    return SequenceMatcher(None, a, b).ratio()


def _reaches(a: str, b: str, least: float) -> bool:
    """``ratio(a, b) >= least``, behind the bound that lengths alone give."""
    total = len(a) + len(b)
    return bool(total) and 2 * min(len(a), len(b)) / total >= least and ratio(a, b) >= least


@lru_cache(200_000)
def word_matches(word: str, least: float = RATIO) -> tuple[tuple[str, str], ...]:
    """(vocabulary, item) that one word stands for.

    An item of one word matches by ratio, or inside the word from four letters on; words much
    shorter than the item never do. Of an item of several words, the space-less form matches.
    """
    found = []
    for name, items in VOCABULARIES.items():
        for item in items:
            if " " in item:
                hit = len(word) >= len(item) - 1 and _reaches(item.replace(" ", ""), word, least)
            else:
                hit = len(word) >= max(3, len(item) - 2) and (_reaches(item, word, least) or len(item) >= 4 and item in word)
            if hit:
                found.append((name, item))
    return tuple(found)


@lru_cache(200_000)
def run_matches(run: str, least: float = RATIO) -> tuple[tuple[str, str], ...]:
    """(vocabulary, item) of several words that a run of as many words stands for."""
    size = run.count(" ")
    return tuple((name, item) for name, items in VOCABULARIES.items() for item in items if item.count(" ") == size and _reaches(item, run, least))


def _matches(find: Callable) -> Callable[[pd.Series], pd.Series]:
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: [{"kind": k, "item": i} for k, i in find(w)])

    return run


def matched_terms(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, kind, item): every vocabulary item found in each text, once."""
    kind = "array<struct<kind:string,item:string>>"
    tokens = texts.select(key, F.filter(F.split(text.entity_text(F.col(column)), " "), lambda t: t != "").alias("tokens"))
    found = None
    for size, find in ((1, word_matches), (2, run_matches)):
        terms = tokens.select(key, F.explode(F.array_distinct(text.token_ngrams(F.col("tokens"), size))).alias("term"))
        # Not deterministic in name only: so the filter stays above the distinct terms and each is looked up once.
        udf = F.pandas_udf(_matches(find), kind).asNondeterministic()
        known = terms.select("term").distinct().withColumn("m", udf("term")).filter(F.size("m") > 0)
        # Dealt by word: the planner takes the size of the table's files for that of its words and would send either side to the driver.
        hits = terms.join(known.hint("shuffle_hash"), "term").select(key, F.inline("m"))
        found = hits if found is None else found.union(hits)
    return found.distinct()


def extract(texts: DataFrame, key: str = "video_id", column: str = "text") -> DataFrame:
    """(key, brands, brand_sources, models, years, years_ambiguous, brand_count, model_count,
    keywords_*): all entities of each text (E6, J6).

    A brand is named ("ocr") or follows from a model ("model_inference"); the first wins.
    """
    terms = materialised(matched_terms(texts, key, column))
    inferred = terms.filter("kind = 'model'").select(key, text.mapped(F.col("item"), lexicon.MODEL_BRAND).alias("brand")).filter("brand IS NOT NULL")
    named = terms.filter("kind = 'brand'").select(key, F.col("item").alias("brand"), F.lit("ocr").alias("source"))
    brands = named.union(inferred.withColumn("source", F.lit("model_inference"))).groupBy(key, "brand").agg(F.max("source").alias("source"))
    sources = F.array_sort(F.collect_list(F.struct("brand", "source")))
    brands = brands.groupBy(key).agg(sources.alias("b"))
    lists = terms.groupBy(key).agg(
        *[F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("item")))).alias(k) for k in VOCABULARIES if k != "brand"]
    )
    none = F.array().cast("array<string>")
    norm = text.entity_text(F.col(column))
    b = F.coalesce("b", F.array().cast("array<struct<brand:string,source:string>>"))
    return (
        texts.select(key, text.exact_years(norm).alias("years"), text.ambiguous_years(norm).alias("years_ambiguous"))
        .join(brands, key, "left").join(lists, key, "left")
        .select(
            key, F.transform(b, lambda x: x["brand"]).alias("brands"), F.map_from_entries(b).alias("brand_sources"),
            F.coalesce("model", none).alias("models"), "years", "years_ambiguous", F.size(b).alias("brand_count"),
            F.size(F.coalesce("model", none)).alias("model_count"),
            *[F.coalesce(f"keyword_{k}", none).alias(f"keywords_{k}") for k in lexicon.KEYWORDS],
        )
    )


def _cased(word: str, corrected: str) -> str:
    """The word's casing on its correction (O2)."""
    return corrected.upper() if word.isupper() else corrected.title() if word.istitle() else corrected


def correct_word(word: str, dictionary: frozenset[str] | None, least: float = 0.82) -> str:
    """One word corrected (O3): forced forms first; known words stay; then the one domain word
    clearly nearest; then the dictionary word clearly nearest of those an edit or two away.

    ``dictionary`` None means no general dictionary: after the domain words, all stay.
    """
    low = word.lower()
    if len(word) < 3:
        return word
    if low in lexicon.FORCED:
        return _cased(word, lexicon.FORCED[low])
    domain = _domain()
    if low in domain or dictionary is None or low in dictionary:
        return word
    near = sorted(((ratio(low, d), d) for d in domain if abs(len(d) - len(low)) <= 2 and _reaches(low, d, least)), key=lambda x: (-x[0], x[1]))
    if near and (len(near) == 1 or near[1][0] <= near[0][0] - 0.04):
        return _cased(word, near[0][1])
    near = sorted(((ratio(low, d), d) for d in _candidates(low, dictionary)), key=lambda x: (-x[0], x[1]))
    if not near or near[0][0] < least or len(near) > 1 and near[1][0] >= near[0][0] - 0.03:
        return word
    return _cased(word, near[0][1])


@lru_cache(1)
def _domain() -> frozenset[str]:
    return frozenset(lexicon.correction_words())


def _edits(word: str) -> set[str]:
    letters = "abcdefghijklmnopqrstuvwxyzáéíóúüñ"
    cuts = [(word[:i], word[i:]) for i in range(len(word) + 1)]
    return (
        {a + b[1:] for a, b in cuts if b} | {a + b[1] + b[0] + b[2:] for a, b in cuts if len(b) > 1}
        | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
    )


def _candidates(word: str, dictionary: frozenset[str]) -> set[str]:
    """Dictionary words one edit away, or else two."""
    one = _edits(word)
    return one & dictionary or {e for o in one for e in _edits(o)} & dictionary


#: Tokens of a text to correct: words with hyphens and apostrophes, or one sign.
TOKEN = r"(?U)[\w'’-]+|[^\s\w]"


def corrected_text(texts: DataFrame, dictionary: frozenset[str] | None, key: str = "video_id", column: str = "text") -> DataFrame:
    """(key, corrected): each word corrected and tokens joined by one space (O4); as they are without a dictionary.

    Distinct words are corrected once. The dictionary is a stated word list, sent to every task.
    """
    if dictionary is None:
        return texts.select(key, F.col(column).alias("corrected"))
    tokens = texts.select(key, F.posexplode(F.regexp_extract_all(F.col(column), F.lit(TOKEN), 0)).alias("at", "token"))
    fix = F.pandas_udf(_corrector(dictionary), "string")
    fixed = tokens.select("token").distinct().filter(F.col("token").rlike(r"(?U)\w")).withColumn("new", fix("token"))
    both = tokens.join(fixed, "token", "left").withColumn("token", F.coalesce("new", "token"))
    joined = both.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]), " ").alias("corrected"))
    return texts.select(key, column).join(joined, key, "left").select(key, F.coalesce("corrected", F.col(column)).alias("corrected"))


def _corrector(dictionary: frozenset[str]) -> Callable[[pd.Series], pd.Series]:
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda w: correct_word(w, dictionary))

    run.__annotations__ = {"words": pd.Series, "return": pd.Series}
    return run


def forced_corrections(word: Column) -> Column:
    """The native part of a word's correction: short words, forced forms and known words (O1, O3)."""
    low = F.lower(word)
    forced = text.mapped(low, lexicon.FORCED)
    return F.when(F.length(word) < 3, word).when(forced.isNotNull(), text.with_case_of(word, forced)).otherwise(word)


def alignment_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbouring letters, none edited twice (optimal string alignment)."""
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        two, one = one, row
    return one[-1]


def _swapped_near(tokens: pd.Series, terms: pd.Series) -> pd.Series:
    return pd.Series([t is not None and any(alignment_distance(t, d) <= 2 for d in ds) for t, ds in zip(tokens, terms)], dtype=bool)


def gate_skips(token: Column) -> Column:
    """Whether the frequency corrector leaves a token alone (O5): short, a year, digits, money, or
    within two edits of a domain term, a swap of neighbouring letters being one edit.

    A swap is two Levenshtein edits, so only terms three or four of those away need the other distance, and only
    tokens without a nearer term.
    """
    terms = F.array(*map(F.lit, lexicon.gate_words()))
    low = F.lower(token)
    money = token.rlike(r"(?i)[$€¢£¥]|USD|COP|EUR|MXN")
    plain = (F.length(token) < 3) | token.rlike("^(19|20)[0-9]{2}$") | token.rlike("^[0-9]+$") | money
    plain = plain | F.exists(terms, lambda d: F.levenshtein(low, d, 2) >= 0)
    further = F.filter(terms, lambda d: F.levenshtein(low, d, 4) >= 3)
    swapped = F.pandas_udf(_swapped_near, "boolean")(F.when(~plain, low), F.when(~plain, further))
    return plain | swapped


def boosted(frequencies: DataFrame) -> DataFrame:
    """(term, n): the dictionary with domain terms on top."""
    domain = frequencies.sparkSession.createDataFrame([(w, 1_000_000_000) for w in lexicon.gate_words()], "term string, n long")
    return frequencies.select("term", "n").union(domain).groupBy("term").agg(F.max("n").alias("n"))


def deletions(word: Column) -> Column:
    """The word and all forms with one letter left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def nearest_terms(tokens: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(token, term, distance): each token's best dictionary term at most one edit away.

    Both sides meet on forms with one letter left out, an equi-join; the distance is then exact.
    Nearest first, then most frequent, then in order of the alphabet.
    """
    left = tokens.select("token").distinct().withColumn("form", F.explode(deletions(F.lower("token"))))
    right = frequencies.select("term", "n", F.explode(deletions(F.col("term"))).alias("form"))
    pairs = left.join(right, "form").select("token", "term", "n").distinct()
    pairs = pairs.withColumn("distance", F.levenshtein(F.lower("token"), "term")).filter("distance <= 1")
    best = pairs.groupBy("token").agg(F.min(F.struct("distance", (-F.col("n")).alias("order"), "term")).alias("b"))
    return best.select("token", "b.term", "b.distance")


def frequency_corrected(texts: DataFrame, frequencies: DataFrame, key: str = "video_id", column: str = "text") -> DataFrame:
    """(key, corrected): tokens replaced by their nearest term, delimiters as they stand."""
    parts = F.regexp_extract_all(F.col(column), F.lit(r"(?U)\s+|[^\w\s]+|\w+"), 0)
    long = texts.select(key, F.posexplode(parts).alias("at", "part"))
    words = long.filter(F.col("part").rlike(r"\p{L}")).groupBy(F.col("part").alias("token")).agg(F.count("*").alias("n"))
    # The count is in the condition so that the gate is asked once for each word, not pushed down to every occurrence.
    words = words.filter(~F.when(F.col("n") > 0, gate_skips(F.col("token")))).select("token")
    found = nearest_terms(words, boosted(frequencies)).select(F.col("token").alias("part"), "term")
    fixed = long.join(found, "part", "left").withColumn("part", F.when(F.col("term").isNull(), F.col("part")).otherwise(text.with_case_of(F.col("part"), F.col("term"))))
    joined = fixed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("corrected"))
    return texts.select(key).join(joined, key, "left").select(key, F.coalesce("corrected", F.lit("")).alias("corrected"))
