"""Title features, entities and corrections against values worked out by hand."""

from __future__ import annotations

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text
from lumenframe.operators import entities


def features(spark, title):
    found = text.title_features(F.col("t"))
    return spark.createDataFrame([(title,)], "t string").select(*found.values()).first().asDict()


def test_golden_title(spark):
    got = features(spark, "¿IONIQ 9 vs Model Y 2026? @canal")
    want = {
        "char_count": 32, "word_count": 7, "sentence_count": 2, "avg_word_length": 3.714, "digit_count": 5, "uppercase_word_count": 1,
        "uppercase_word_ratio": 0.143, "has_question_mark": True, "starts_with_question": True, "exclamation_count": 0, "emoji_count": 0, "year_mentions": 1,
        "has_price_framing": False, "has_superlative": False, "has_comparative": True, "has_list_number": False, "brand_count": 0, "model_count": 2,
        "has_brand_or_model": True, "has_model_year": True, "has_review_keyword": False, "pipe_section_count": 0, "hashtag_count": 0, "is_collab": True,
    }
    assert {k: got[k] for k in want} == want and len(got) == 33


@pytest.mark.parametrize(
    ("title", "name", "value"),
    [
        ("stop", "has_superlative", True), ("programa", "brand_count", 1), ("12025", "year_mentions", 0), ("grand cherokee", "model_count", 1),
        ("#a#b", "hashtag_count", 1), ("©", "emoji_count", 1), ("  hola \t", "char_count", 4), ("70 millones", "has_currency_cop", True),
        ("US$ 5", "has_currency_usd", True), ("cuánto cuesta", "has_price_framing", True), ("top 5 autos", "has_list_number", True), ("😀", "char_count", 1),
        ("eléctrico ÑANDÚ", "uppercase_word_count", 1), (None, "word_count", 0), ("", "sentence_count", 0),
    ],
)
def test_edge_titles(spark, title, name, value):
    assert features(spark, title)[name] == value


def test_lexicon_sizes():
    assert (len(lexicon.BRANDS), len(lexicon.MODELS), len(lexicon.MODEL_BRAND)) == (64, 181, 175)
    assert len(lexicon.FORCED) == 20 and sum(map(len, lexicon.YEAR_READINGS.values())) == 32 and len(set(lexicon.MODELS)) == 181


def extracted(spark, value):
    return entities.extract(spark.createDataFrame([(1, value)], "video_id long, text string")).first().asDict()


def test_entities(spark):
    got = extracted(spark, "ioniq")
    assert got["models"] == ["ioniq"] and got["brands"] == ["hyundai"] and got["brand_sources"] == {"hyundai": "model_inference"}
    assert extracted(spark, "hyundai ioniq")["brand_sources"] == {"hyundai": "ocr"}
    short = extracted(spark, "vw mg ev")
    assert short["brands"] == [] and short["keywords_powertrain"] == []
    assert extracted(spark, "Land-Rover grand  Cherokes 2024 NUEVOS")["models"] == ["cherokee", "grand cherokee"]
    assert extracted(spark, "x120245")["years"] == [2024]
    none = extracted(spark, "")
    assert none["years_ambiguous"] == [] and none["brand_count"] == 0


@pytest.mark.parametrize(("span", "years"), [("20v6", [2006, 2026]), ("20z4", [2024]), ("zozs", [2025]), ("20xx", [])])
def test_year_readings(spark, span, years):
    df = spark.createDataFrame([(span,)], "s string")
    assert df.select(text.ambiguous_years(F.col("s"))).first()[0] == years


def test_ratio_bound_is_exact():
    words = [*lexicon.BRANDS, *lexicon.MODELS]
    for a in words[::7]:
        for b in words[::5]:
            assert entities._reaches(a, b, 0.85) == (SequenceMatcher(None, a, b).ratio() >= 0.85)


def test_corrections():
    known = frozenset({"casa", "carretera", "mejor", "auto"})
    pairs = {"CADILLAE": "CADILLAC", "hbrido": "híbrido", "IdBu2": "idbuzz", "de": "de", "SUBARU": "SUBARU", "carretra": "carretera", "Toyoto": "Toyota", "zzzz": "zzzz"}
    assert {w: entities.correct_word(w, known) for w in pairs} == pairs
    assert entities.correct_word("carretra", None) == "carretra"


def test_frequency_correction(spark):
    freq = spark.createDataFrame([("carretera", 50), ("carreteras", 5), ("montaña", 9)], "term string, n long")
    rows = spark.createDataFrame([(1, "La  carretra, CARRETERS!"), (2, ""), (3, "2024 gasona $5")], "video_id long, text string")
    got = {r["video_id"]: r["corrected"] for r in entities.frequency_corrected(rows, freq).collect()}
    assert got == {1: "La  carretera, CARRETERA!", 2: "", 3: "2024 gasona $5"}


@pytest.mark.parametrize(
    ("raw", "want"),
    [("The fox jumps. The fox jumps. Something else.", "The fox jumps."), ("One thing. Another thing.", "One thing. Another thing."), ("No end", "No end."), ("", "")],
)
def test_repeat_collapse(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(text.collapse_repeats(F.col("t"))).first()[0] == want
