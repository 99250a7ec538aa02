"""Column expressions over titles and recognised text."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe import lexicon

# These patterns decide results.
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F2FF}\p{So}]"
YEAR = r"(?U)(?<!\d)20[1-3]\d(?!\d)"
COP = r"(?iU)\$\s?\d|cop\b|colombian?os?\b|\bpesos?\b|\bmillones?\b"
USD = r"(?iU)\bus\s?\$|\busd\b|\bdolares\b|\bdólares\b|\buss?\$?\s*\d"
PRICE = r"(?iU)\b(cuesta|precio|cuanto|cuánto|millones?)\b"
LIST_START = r"(?iU)^\s*(\d+|top\s*\d+|\d+\s*autos?|\d+\s*carros?|\d+\s*suvs?)\b"


def stripped(text: Column) -> Column:
    """Without white space at the ends, in the Unicode sense."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words is a substring."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def count_contained(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words are substrings."""
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))


def whole_term_pattern(terms: tuple[str, ...]) -> str:
    """Any of the terms standing alone, longer ones first so that they are not cut short."""
    return r"(?iU)(?<!\w)(?:" + "|".join(re.escape(t).replace(r"\-", "-") for t in sorted(terms, key=len, reverse=True)) + r")(?!\w)"


def title_features(title: Column) -> dict[str, Column]:
    """All outputs of the title features (T1 to T28) by name; null and empty titles give zeros."""
    s = stripped(F.coalesce(title, F.lit("")))
    low = F.lower(s)
    count = lambda pattern: F.regexp_count(s, F.lit(pattern))
    words = count(r"(?U)\S+")
    letters = F.length(F.regexp_replace(s, r"(?U)\s+", ""))
    upper = F.size(F.filter(F.split(s, r"(?U)\s+"), lambda t: (F.length(t) >= 3) & (t == F.upper(t)) & t.rlike(r"\p{Lu}")))
    brands, years = count_contained(low, lexicon.BRANDS), count(YEAR)
    models = F.size(F.array_distinct(F.regexp_extract_all(low, F.lit(whole_term_pattern(lexicon.MODELS)), 0)))
    cop, usd = s.rlike(COP), s.rlike(USD)
    named = (brands > 0) | (models > 0)
    share = lambda a: F.when(words > 0, F.round(a / words, 3)).otherwise(0.0)
    out = {
        "char_count": F.length(s), "word_count": words, "sentence_count": F.when(s == "", 0).otherwise(F.greatest(count(r"[.!?¿¡]+"), F.lit(1))),
        "avg_word_length": share(letters), "digit_count": count(r"(?U)\d"), "has_digit": s.rlike(r"(?U)\d"),
        "uppercase_word_count": upper, "uppercase_word_ratio": share(upper), "has_question_mark": s.rlike("[?¿]"),
        "starts_with_question": s.rlike(r"^\s*[¿?]"), "exclamation_count": count("[!¡]"), "has_emoji": s.rlike(EMOJI), "emoji_count": count(EMOJI),
        "has_year": years > 0, "year_mentions": years, "has_currency_cop": cop, "has_currency_usd": usd, "has_price_framing": cop | usd | s.rlike(PRICE),
        "has_superlative": contains_any(low, (*lexicon.SUPERLATIVES, "#1")), "has_negation": contains_any(low, lexicon.NEGATIONS),
        "has_comparative": contains_any(low, lexicon.COMPARATIVES), "has_list_number": s.rlike(LIST_START), "has_brand_mention": brands > 0,
        "brand_count": brands, "has_model_mention": models > 0, "model_count": models, "has_brand_or_model": named, "has_model_year": named & (years > 0),
        "has_review_keyword": contains_any(low, lexicon.REVIEW_KEYWORDS), "has_curiosity_hook": contains_any(low, lexicon.CURIOSITY_HOOKS),
        "pipe_section_count": count(r"\|"), "hashtag_count": count(r"(?U)(?<!\w)#\w+"),
        "is_collab": s.rlike(r"(?U)(?<!\w)@\w{2,}") | contains_any(low, lexicon.COLLAB_KEYWORDS),
    }
    return {name: c.alias(name) for name, c in out.items()}


def mapped(text: Column, table: dict[str, str]) -> Column:
    """The table's value for ``text``, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), text)


def canonical(text: Column, table: dict[str, str]) -> Column:
    """Lower-cased and, where it is an alias, replaced by what it stands for."""
    low = F.lower(text)
    return F.coalesce(mapped(low, table), low)


def canonical_set(items: Column, table: dict[str, str]) -> Column:
    """Distinct canonical forms, sorted; blank items go (E9). A null list is empty."""
    named = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: stripped(x) != "")
    return F.array_sort(F.array_distinct(F.transform(named, lambda x: canonical(x, table))))


def title_case(text: Column) -> Column:
    """The first letter of each run of letters in upper case, the others in lower."""
    letters = F.split(F.lower(text), "")
    return F.array_join(F.transform(letters, lambda c, i: F.when((i == 0) | ~F.element_at(letters, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(c)).otherwise(c)), "")


def with_case_of(word: Column, corrected: Column) -> Column:
    """``corrected`` in upper case where ``word`` is, in title case where each of its runs of letters is, else as it is (O2)."""
    titled = word.rlike(r"^(?:[^\p{L}]*(?<!\p{L})\p{Lu}\p{Ll}*)+[^\p{L}]*$")
    return F.when((word == F.upper(word)) & (word != F.lower(word)), F.upper(corrected)).when(titled, title_case(corrected)).otherwise(corrected)


def strict_text(text: Column) -> Column:
    """White space collapsed."""
    return stripped(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def _unmarked(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def lenient_text(text: Column) -> Column:
    """Compatibility forms taken apart and marks stripped (NFKD), lower-cased, white space collapsed.

    Texts of ASCII have nothing to take apart: only others go through Python.
    """
    text = F.coalesce(text, F.lit(""))
    beyond = text.rlike(r"[^\x00-\x7F]")
    plain = F.when(beyond, F.pandas_udf(_unmarked, "string")(F.when(beyond, text))).otherwise(text)
    return strict_text(F.lower(plain))


def entity_text(text: Column) -> Column:
    """Lower case; all but word characters, spaces and hyphens to spaces; collapsed."""
    return strict_text(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s-]", " "))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def exact_years(text: Column) -> Column:
    """Years 1970 to 2030 anywhere in the text, sorted, as integers (E5)."""
    found = F.regexp_extract_all(text, F.lit(r"19[7-9][0-9]|20[0-2][0-9]|2030"), 0)
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def readings(span: Column) -> Column:
    """All years that four misread characters may stand for."""
    digits = lambda i: F.split(F.coalesce(mapped(F.substring(span, i, 1), {k: v for k, v in lexicon.YEAR_READINGS.items()}), F.lit("x")), "")
    parts = [F.filter(digits(i), lambda d: d != "") for i in range(1, 5)]
    joined = lambda left, right: F.flatten(F.transform(left, lambda a: F.transform(right, lambda b: F.concat(a, b))))
    grown = reduce(joined, parts)
    low, high = lexicon.YEARS
    years = F.filter(F.transform(grown, lambda y: y.try_cast("int")), lambda y: y.isNotNull() & y.between(low, high))
    return F.when(F.length(span) == 4, years).otherwise(F.array().cast("array<int>"))


def ambiguous_years(text: Column) -> Column:
    """Readings of year-like spans that are not exact years of the text (E5)."""
    spans = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)[12zir][09onod]\w{2}"), 0)
    return F.array_sort(F.array_except(F.array_distinct(F.flatten(F.transform(spans, readings))), exact_years(text)))


def collapse_repeats(text: Column) -> Column:
    """Sentences up to the first that holds or is held by an earlier one; ends with . or ?."""
    sentences = F.split(text, r"(?<=[.?])\s+")
    zero = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("done"))

    def step(s: Column, x: Column) -> Column:
        clean = F.lower(F.trim(x))
        again = F.exists(s["kept"], lambda k: (clean != "") & (F.contains(F.lower(k), clean) | F.contains(clean, F.lower(k))))
        kept = F.when(s["done"] | again, s["kept"]).otherwise(F.concat(s["kept"], F.array(F.trim(x))))
        return F.struct(kept.alias("kept"), (s["done"] | again).alias("done"))

    joined = F.array_join(F.aggregate(sentences, zero, step, lambda s: s["kept"]), " ")
    return F.when((joined == "") | joined.rlike(r"[.?]$"), joined).otherwise(F.concat(joined, F.lit(".")))


def token_ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by spaces."""
    size = F.size(tokens)
    return F.when(size >= n, F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))
