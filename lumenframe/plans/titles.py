"""Queries over titles and recognised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text
from lumenframe.operators import entities
from lumenframe.sources import files, tables
from lumenframe.sources.tables import TITLES_SQL

BASIC = ("char_count", "word_count", "sentence_count", "avg_word_length", "digit_count", "has_digit", "uppercase_word_count", "uppercase_word_ratio", "has_question_mark", "starts_with_question", "exclamation_count", "has_emoji", "emoji_count", "pipe_section_count", "hashtag_count")
LEXICAL = ("has_superlative", "has_negation", "has_comparative", "has_list_number", "has_review_keyword", "has_curiosity_hook")
CURRENCY = ("has_currency_cop", "has_currency_usd", "has_price_framing")
NAMES = ("has_brand_mention", "brand_count", "has_model_mention", "model_count", "has_brand_or_model", "has_model_year")
WHITELIST = tuple(range(1, 400, 7))


def _features(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    found = text.title_features(F.col("title"))
    return tables.titles(spark, sf_dir).select("video_id", *[found[n] for n in names])


def title_features_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, BASIC)


def title_features_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, LEXICAL)


def title_features_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, CURRENCY)


def title_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, ("has_year", "year_mentions"))


def brand_model_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir, NAMES)


def collab_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title's sign or the whitelist."""
    listed = spark.createDataFrame([(i,) for i in WHITELIST], "video_id long").withColumn("listed", F.lit(True))
    found = _features(spark, sf_dir, ("is_collab",)).join(F.broadcast(listed), "video_id", "left")
    return found.select("video_id", "is_collab", (F.col("is_collab") | F.coalesce("listed", F.lit(False))).alias("is_collab_video"))


def whitelist_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles on the whitelist."""
    listed = spark.createDataFrame([(i,) for i in WHITELIST], "video_id long")
    return tables.titles(spark, sf_dir).join(F.broadcast(listed), "video_id", "left_semi")


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words of titles and, in place of misread ones, the forced table's keys."""
    words = tables.titles(spark, sf_dir).select(F.explode(F.split("title", " ")).alias("word")).filter("word <> ''")
    forced = spark.createDataFrame([(w,) for k in lexicon.FORCED for w in (k, k.upper(), k.capitalize(), "de", "Gasona", "2024", "$70", "hibrdo", "ogl", "jeeep", "bulck", "mzada")], "word string")
    return words.union(forced).distinct()


def alias_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables_ = {"brand": lexicon.BRAND_ALIASES, "model": lexicon.MODEL_ALIASES, "keyword": lexicon.KEYWORD_ALIASES}
    terms = spark.createDataFrame([(w,) for t in tables_.values() for w in t], "word string")
    rows = _words(spark, sf_dir).union(terms).union(terms.select(F.upper("word"))).distinct()
    return rows.select("word", *[text.canonical(F.col("word"), t).alias(n) for n, t in tables_.items()])


def forced_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", entities.forced_corrections(F.col("word")).alias("corrected"))


def symspell_gate_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("word", entities.gate_skips(F.col("word")).alias("skipped"))


def delete_neighborhood_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words against a frequency list made of all the documents' words."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), 0))
    freq = tables.table(spark, sf_dir, "documents").select(words("text").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    tokens = tables.table(spark, sf_dir, "pages").select(words("url").alias("token")).union(freq.select(F.expr("substr(term, 2)").alias("token"))).filter("token <> ''")
    return entities.nearest_terms(tokens, freq)


def _misread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles with digits misread as letters."""
    return tables.titles(spark, sf_dir).withColumn("text", F.when(F.col("video_id") % 2 == 0, F.translate("title", "01", "oi")).otherwise(F.translate("title", "4", "v")))


def year_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    norm = text.entity_text(F.col("text"))
    joined = lambda c: F.array_join(c.cast("array<string>"), ",")
    return _misread(spark, sf_dir).select("video_id", joined(text.exact_years(norm)).alias("years"), joined(text.ambiguous_years(norm)).alias("ambiguous"))


def year_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of every four-letter run of misread titles."""
    spans = _misread(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[0-9a-z]{4}"), 0)).alias("span")).distinct()
    return spans.select("span", F.explode(F.array_distinct(text.readings(F.col("span")))).alias("year"))


def model_to_brand_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = spark.createDataFrame([(m,) for m in lexicon.MODELS], "model string")
    return models.select("model", text.mapped(F.col("model"), lexicon.MODEL_BRAND).alias("brand"))


def fuzzy_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of misread titles, each list as text."""
    found = entities.extract(_misread(spark, sf_dir))
    sources = F.transform(F.array_sort(F.map_entries("brand_sources")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    lists = [c for c in found.columns if c not in ("video_id", "brand_sources", "brand_count", "model_count")]
    return found.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in lists} | {"brand_sources": F.array_join(sources, ",")})


def title_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two words of each title."""
    tokens = F.filter(F.split(text.entity_text(F.col("title")), " "), lambda t: t != "")
    return tables.titles(spark, sf_dir).select("video_id", F.explode(text.token_ngrams(tokens, 2)).alias("bigram"))


def path_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder and stem of each page's address."""
    return files.path_columns(tables.table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.lit("/chan/img-"), F.col("page_id").cast("string"), F.lit(".jpg")).alias("path")))


def frequency_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles corrected against the words of the benchmark."""
    words = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("term"))
    return entities.frequency_corrected(_misread(spark, sf_dir), words.groupBy("term").agg(F.count("*").alias("n")))


def ocr_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misread titles corrected against the domain's words and the benchmark's as a general dictionary."""
    words = tables.table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w")).distinct()
    return entities.corrected_text(_misread(spark, sf_dir), frozenset(r["w"] for r in words.collect()))


def repeat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", F.lit(" "), F.regexp_extract("text", r"^[^.]*\.", 0), F.lit(" More follows")).alias("t"))
    return rows.select("item_id", text.collapse_repeats(F.col("t")).alias("collapsed"))


def _contains(words: tuple[str, ...], low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_T = rf"""t AS (SELECT video_id, regexp_replace(title, '^\s+|\s+$', '', 'g') AS s FROM ({TITLES_SQL})),
l AS (SELECT *, lower(s) AS low, list_filter(regexp_extract_all(s, '[^\s]+'), lambda x: true) AS tokens FROM t)"""
_MODEL = "|".join(m.replace(".", r"\.") for m in sorted(lexicon.MODELS, key=len, reverse=True))
# RE2 has no look-around: text is cut at everything that is no word character, and the models, whose own
# hyphens, dots and spaces are written as private letters first, are looked up among the pieces.
_YEARS = r"len(list_filter(regexp_extract_all(s, '[0-9]+'), lambda x: regexp_full_match(x, '20[1-3][0-9]')))"
_MODEL_HITS = "list_distinct(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}_])' || '{m.replace('.', chr(92) + '.')}' || '($|[^\\p{{L}}\\p{{N}}_])') THEN '{m}' END" for m in lexicon.MODELS) + "], lambda x: x IS NOT NULL))"
_WORDS = f"""words AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(title, ' ')) AS word FROM ({TITLES_SQL})) WHERE word <> ''
  UNION SELECT unnest({[w for k in lexicon.FORCED for w in (k, k.upper(), k.capitalize(), 'de', 'Gasona', '2024', '$70', 'hibrdo', 'ogl', 'jeeep', 'bulck', 'mzada')]}))"""
_MIS = f"m AS (SELECT video_id, CASE WHEN video_id % 2 = 0 THEN translate(title, '01', 'oi') ELSE translate(title, '4', 'v') END AS text FROM ({TITLES_SQL}))"
_READ = "r(c, d) AS (VALUES " + ", ".join(f"('{c}', '{d}')" for c, ds in lexicon.YEAR_READINGS.items() for d in ds) + ")"
_NORM = r"regexp_replace(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s-]', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_EXPAND = "SELECT DISTINCT span, (a.d || b.d || c.d || e.d)::INT AS year FROM spans JOIN r a ON a.c = span[1] JOIN r b ON b.c = span[2] JOIN r c ON c.c = span[3] JOIN r e ON e.c = span[4] WHERE (a.d || b.d || c.d || e.d)::INT BETWEEN 1970 AND 2030"

#: Of tokens d(token) and terms f(term, n): the best term one edit away at most, met on forms with a letter left out.
_FORMS = "list_distinct(list_prepend({0}, list_transform(generate_series(1, length({0})), lambda i: {0}[:i - 1] || {0}[i + 1:])))"
_NEAREST = f"""df AS (SELECT token, unnest({_FORMS.format('lower(token)')}) AS form FROM d), ff AS (SELECT term, n, unnest({_FORMS.format('term')}) AS form FROM f),
      pr AS (SELECT DISTINCT token, term, n FROM df JOIN ff USING (form)), ds AS (SELECT *, levenshtein(lower(token), term) AS distance FROM pr),
      r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, n DESC, term) AS k FROM ds WHERE distance <= 1)"""
_GATED = rf"""gated AS (SELECT word, length(word) < 3 OR regexp_full_match(word, '(19|20)[0-9]{{2}}') OR regexp_full_match(word, '[0-9]+')
      OR regexp_matches(word, '(?i)[$€¢£¥]|USD|COP|EUR|MXN') OR list_min(list_transform({list(lexicon.gate_words())}, lambda d: damerau_levenshtein(lower(word), d))) <= 2 AS skipped FROM words)"""
_VOCABULARY = "vocab(kind, item) AS (VALUES " + ", ".join(f"('{k}', '{i}')" for k, items in entities.VOCABULARIES.items() for i in items) + ")"
#: Of pairs p(a, b): their ratio, by taking the longest common run (of equals the first) and going on to its left and right.
_RATIO = """sm AS (SELECT a, b, a AS l, b AS r, 0::BIGINT AS got FROM p
        UNION ALL SELECT a, b, q.l, q.r, q.got FROM (SELECT a, b, unnest([{'l': l[:i - 1], 'r': r[:j - 1], 'got': k}, {'l': l[i + k:], 'r': r[j + k:], 'got': 0}]) AS q
          FROM (SELECT a, b, l, r, i, k, instr(r, l[i:i + k - 1]) AS j FROM (SELECT a, b, l, r, 1000 - best % 1000 AS i, best // 1000 AS k FROM (
            SELECT a, b, l, r, list_max(list_transform(list_filter(flatten(list_transform(generate_series(1, length(l)), lambda i: list_transform(generate_series(1, length(l) - i + 1), lambda k: {'i': i, 'k': k}))),
              lambda o: contains(r, l[o.i:o.i + o.k - 1])), lambda o: o.k * 1000 + 1000 - o.i)) AS best FROM sm WHERE l <> '' AND r <> '') WHERE best IS NOT NULL)))),
      ratio AS (SELECT a, b, 2.0::DOUBLE * sum(got) / (length(a) + length(b)) AS ratio FROM sm GROUP BY a, b)"""
_alike = lambda a, b: f"2 * least(length({a}), length({b}))::DOUBLE / (length({a}) + length({b})) >= 0.85"
_ENTITIES = f"""{_VOCABULARY}, tok AS (SELECT video_id, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS w FROM m),
      terms AS (SELECT DISTINCT video_id, 0 AS gap, unnest(w) AS term FROM tok UNION SELECT video_id, 1, unnest(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) FROM tok),
      known AS (SELECT DISTINCT gap, term FROM terms),
      met AS (SELECT term, kind, item, CASE WHEN gap = 0 THEN replace(item, ' ', '') ELSE item END AS a, gap = 0 AND NOT contains(item, ' ') AND length(item) >= 4 AND contains(term, item) AS within
        FROM known JOIN vocab ON CASE WHEN gap = 1 THEN length(item) - length(replace(item, ' ', '')) = 1 WHEN contains(item, ' ') THEN length(term) >= length(item) - 1 ELSE length(term) >= greatest(3, length(item) - 2) END),
      p AS (SELECT DISTINCT a, term AS b FROM met WHERE {_alike('a', 'term')}), {_RATIO},
      hits AS (SELECT DISTINCT video_id, kind, item FROM terms JOIN met USING (term) LEFT JOIN ratio ON ratio.a = met.a AND ratio.b = met.term WHERE within OR ratio >= 0.85),
      src AS (SELECT video_id, brand, max(source) AS source FROM (SELECT video_id, item AS brand, 'ocr' AS source FROM hits WHERE kind = 'brand'
        UNION ALL SELECT video_id, {_map(lexicon.MODEL_BRAND)}[item], 'model_inference' FROM hits WHERE kind = 'model') WHERE brand IS NOT NULL GROUP BY video_id, brand),
      br AS (SELECT video_id, string_agg(brand, ',' ORDER BY brand) AS brands, string_agg(brand || ':' || source, ',' ORDER BY brand) AS brand_sources, count(*)::INT AS brand_count FROM src GROUP BY video_id),
      ls AS (SELECT video_id, count_if(kind = 'model')::INT AS model_count, string_agg(item, ',' ORDER BY item) FILTER (kind = 'model') AS models,
        {', '.join(f"string_agg(item, ',' ORDER BY item) FILTER (kind = 'keyword_{k}') AS keywords_{k}" for k in lexicon.KEYWORDS)} FROM hits GROUP BY video_id)
      SELECT m.video_id, coalesce(brands, '') AS brands, coalesce(brand_sources, '') AS brand_sources, coalesce(models, '') AS models, y.years, y.ambiguous AS years_ambiguous,
      coalesce(brand_count, 0) AS brand_count, coalesce(model_count, 0) AS model_count, {', '.join(f"coalesce(keywords_{k}, '') AS keywords_{k}" for k in lexicon.KEYWORDS)}
      FROM m LEFT JOIN br USING (video_id) LEFT JOIN ls USING (video_id) JOIN years y USING (video_id)"""
_TITLE_CASE = r"array_to_string(list_transform(regexp_extract_all({0}, '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '')"
_CASED = rf"""CASE WHEN part = upper(part) AND part <> lower(part) THEN upper(new) WHEN regexp_full_match(part, '([^\p{{L}}]*\p{{Lu}}\p{{Ll}}*)+[^\p{{L}}]*') THEN {_TITLE_CASE.format('new')} ELSE new END"""
#: Of texts m(video_id, text): corrected(video_id, text). Dictionary words one or two edits away are those of that distance.
_CORRECTED = rf"""dict AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS d FROM benchmark), dom AS (SELECT unnest({list(lexicon.correction_words())}) AS d),
      q AS (SELECT video_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}_''’-]+|[^\s\p{{L}}\p{{N}}_]') AS parts FROM m), u AS (SELECT video_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS spot FROM q),
      seen AS (SELECT DISTINCT part, lower(part) AS low, {_map(lexicon.FORCED)}[lower(part)] AS forced FROM u WHERE length(part) >= 3 AND regexp_matches(part, '[\p{{L}}\p{{N}}_]')),
      unknown AS (SELECT DISTINCT low FROM seen WHERE forced IS NULL AND low NOT IN (SELECT d FROM dom) AND low NOT IN (SELECT d FROM dict)),
      p AS (SELECT low AS a, d AS b FROM unknown JOIN dom ON abs(length(d) - length(low)) <= 2 UNION SELECT low, d FROM unknown JOIN dict ON damerau_levenshtein(low, d) <= 2), {_RATIO},
      near AS (SELECT a, b, ratio, lead(ratio) OVER w AS next, row_number() OVER w AS k FROM ratio JOIN dom ON d = b WHERE abs(length(a) - length(b)) <= 2 AND ratio >= 0.82::DOUBLE WINDOW w AS (PARTITION BY a ORDER BY ratio DESC, b)),
      edits AS (SELECT a, b, ratio, damerau_levenshtein(a, b) AS e FROM ratio JOIN dict ON d = b), least_edits AS (SELECT * FROM edits WHERE e <= 2 QUALIFY e = min(e) OVER (PARTITION BY a)),
      close AS (SELECT a, b, ratio, lead(ratio) OVER w AS next, row_number() OVER w AS k FROM least_edits WINDOW w AS (PARTITION BY a ORDER BY ratio DESC, b)),
      fixed AS (SELECT part, coalesce(forced, near.b, close.b) AS new FROM seen LEFT JOIN near ON near.a = low AND near.k = 1 AND (near.next IS NULL OR near.next <= near.ratio - 0.04::DOUBLE)
        LEFT JOIN close ON close.a = low AND close.k = 1 AND close.ratio >= 0.82::DOUBLE AND (close.next IS NULL OR close.next < close.ratio - 0.03::DOUBLE)),
      corrected AS (SELECT video_id, coalesce(string_agg(coalesce({_CASED}, part), ' ' ORDER BY spot), any_value(text)) AS text FROM m LEFT JOIN u USING (video_id) LEFT JOIN fixed USING (part) GROUP BY video_id)"""


def entities_sql(source: str) -> str:
    """SQL of the entities in the texts of ``source`` (video_id, text)."""
    m = f"m AS (SELECT video_id, text FROM {source})"
    years = ORACLE_SQL["year_detection"].replace(_MIS, m)
    return f"WITH RECURSIVE {m}, {_ENTITIES.replace(' JOIN years y ', f' JOIN ({years}) y ')}"


QUERIES = {
    f.__name__: f
    for f in (
        title_features_basic, title_features_lexical, title_features_currency, title_years, brand_model_counts, collab_flag, whitelist_semi_join,
        alias_canonicalize, forced_corrections, symspell_gate_native, delete_neighborhood_lookup, year_detection, year_expansion,
        model_to_brand_inference, fuzzy_entities, repeat_collapse, title_bigrams, path_columns, frequency_corrected, ocr_corrected,
    )
}
ORACLE_SQL = {
    "title_features_basic": rf"""WITH {_T}, c AS (SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda x: length(x) >= 3 AND x = upper(x) AND regexp_matches(x, '\p{{Lu}}'))) AS up,
      len(regexp_extract_all(s, '[\x{{1F300}}-\x{{1FAFF}}\x{{2600}}-\x{{27BF}}\x{{1F000}}-\x{{1F2FF}}\p{{So}}]')) AS emo, len(regexp_extract_all(s, '[0-9]')) AS dig FROM l)
      SELECT video_id, length(s) AS char_count, n AS word_count, greatest(len(regexp_extract_all(s, '[.!?¿¡]+')), 1) AS sentence_count,
      round(list_sum(list_transform(tokens, lambda x: length(x)))::DOUBLE / n, 3) AS avg_word_length, dig AS digit_count, dig > 0 AS has_digit, up AS uppercase_word_count,
      round(up::DOUBLE / n, 3) AS uppercase_word_ratio, contains(s, '?') OR contains(s, '¿') AS has_question_mark, regexp_matches(s, '^\s*[¿?]') AS starts_with_question,
      len(regexp_extract_all(s, '[!¡]')) AS exclamation_count, emo > 0 AS has_emoji, emo AS emoji_count, len(regexp_extract_all(s, '\|')) AS pipe_section_count,
      len(regexp_extract_all(' ' || s, '[^\p{{L}}\p{{N}}_]#[\p{{L}}\p{{N}}_]+')) AS hashtag_count FROM c""",
    "title_features_lexical": rf"""WITH {_T} SELECT video_id, {_contains((*lexicon.SUPERLATIVES, '#1'))} AS has_superlative, {_contains(lexicon.NEGATIONS)} AS has_negation,
      {_contains(lexicon.COMPARATIVES)} AS has_comparative, regexp_matches(s, '(?i)^\s*([0-9]+|top\s*[0-9]+)($|[^\p{{L}}\p{{N}}_])') AS has_list_number,
      {_contains(lexicon.REVIEW_KEYWORDS)} AS has_review_keyword, {_contains(lexicon.CURIOSITY_HOOKS)} AS has_curiosity_hook FROM l""",
    "title_features_currency": rf"""WITH {_T}, c AS (SELECT video_id, regexp_matches(s, '(?i)\$\s?[0-9]|cop\b|colombian?os?\b|\bpesos?\b|\bmillones?\b') AS cop,
      regexp_matches(s, '(?i)\bus\s?\$|\busd\b|\bdolares\b|dólares|\buss?\$?\s*[0-9]') AS usd, regexp_matches(s, '(?i)\b(cuesta|precio|cuanto|millones?)\b') AS price FROM l)
      SELECT video_id, cop AS has_currency_cop, usd AS has_currency_usd, cop OR usd OR price AS has_price_framing FROM c""",
    "title_years": f"WITH {_T} SELECT video_id, {_YEARS} > 0 AS has_year, {_YEARS} AS year_mentions FROM l",
    "brand_model_counts": f"""WITH {_T}, c AS (SELECT video_id, len(list_filter({list(lexicon.BRANDS)}, lambda b: contains(low, b))) AS b, len({_MODEL_HITS}) AS m, {_YEARS} AS y FROM l)
      SELECT video_id, b > 0 AS has_brand_mention, b AS brand_count, m > 0 AS has_model_mention, m AS model_count, b > 0 OR m > 0 AS has_brand_or_model, (b > 0 OR m > 0) AND y > 0 AS has_model_year FROM c""",
    "collab_flag": rf"""WITH {_T}, c AS (SELECT video_id, regexp_matches(' ' || s, '[^\p{{L}}\p{{N}}_]@[\p{{L}}\p{{N}}_]{{2,}}') OR {_contains(lexicon.COLLAB_KEYWORDS)} AS is_collab FROM l)
      SELECT *, is_collab OR video_id IN {WHITELIST} AS is_collab_video FROM c""",
    "whitelist_semi_join": f"SELECT * FROM ({TITLES_SQL}) WHERE video_id IN {WHITELIST}",
    "alias_canonicalize": f"""WITH {_WORDS}, terms AS (SELECT unnest({[w for t in (lexicon.BRAND_ALIASES, lexicon.MODEL_ALIASES, lexicon.KEYWORD_ALIASES) for w in t]}) AS word),
      w AS (SELECT word FROM words UNION SELECT word FROM terms UNION SELECT upper(word) FROM terms)
      SELECT word, coalesce({_map(lexicon.BRAND_ALIASES)}[lower(word)], lower(word)) AS brand, coalesce({_map(lexicon.MODEL_ALIASES)}[lower(word)], lower(word)) AS model,
      coalesce({_map(lexicon.KEYWORD_ALIASES)}[lower(word)], lower(word)) AS keyword FROM w""",
    "forced_corrections": f"""WITH {_WORDS}, f AS (SELECT word, {_map(lexicon.FORCED)}[lower(word)] AS forced FROM words)
      SELECT word, CASE WHEN length(word) < 3 OR forced IS NULL THEN word WHEN word = upper(word) AND word <> lower(word) THEN upper(forced)
      WHEN regexp_full_match(word, '([^\\p{{L}}]*\\p{{Lu}}\\p{{Ll}}*)+[^\\p{{L}}]*') THEN array_to_string(list_transform(string_split(forced, ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE forced END AS corrected FROM f""",
    "symspell_gate_native": rf"""WITH {_WORDS} SELECT word, length(word) < 3 OR regexp_full_match(word, '(19|20)[0-9]{{2}}') OR regexp_full_match(word, '[0-9]+')
      OR regexp_matches(word, '(?i)[$€¢£¥]|USD|COP|EUR|MXN') OR list_min(list_transform({list(entities.lexicon.gate_words())}, lambda d: damerau_levenshtein(lower(word), d))) <= 2 AS skipped FROM words""",
    "delete_neighborhood_lookup": f"""WITH f AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents) GROUP BY term),
      w AS (SELECT unnest(regexp_extract_all(lower(url), '[a-z]+')) AS token FROM pages UNION SELECT substr(term, 2) FROM f), d AS (SELECT DISTINCT token FROM w WHERE token <> ''), {_NEAREST}
      SELECT token, term, distance::INT AS distance FROM r WHERE k = 1""",
    "frequency_corrected": rf"""WITH {_MIS}, f AS (SELECT term, max(n) AS n FROM (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark) GROUP BY term
        UNION ALL SELECT unnest({list(lexicon.gate_words())}), 1000000000) GROUP BY term),
      q AS (SELECT video_id, regexp_extract_all(text, '[\s]+|[^\p{{L}}\p{{N}}_\s]+|[\p{{L}}\p{{N}}_]+') AS parts FROM m),
      u AS (SELECT video_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS spot FROM q),
      o AS (SELECT DISTINCT part AS word FROM u WHERE regexp_matches(part, '\p{{L}}')), {_GATED.replace('FROM words', 'FROM o')},
      d AS (SELECT word AS token FROM gated WHERE NOT skipped), {_NEAREST},
      b AS (SELECT token, term FROM r WHERE k = 1),
      x AS (SELECT video_id, spot, CASE WHEN term IS NULL THEN part WHEN part = upper(part) AND part <> lower(part) THEN upper(term)
        WHEN regexp_full_match(part, '([^\p{{L}}]*\p{{Lu}}\p{{Ll}}*)+[^\p{{L}}]*') THEN array_to_string(list_transform(regexp_extract_all(term, '\p{{L}}+|[^\p{{L}}]+'), lambda w: upper(w[1]) || lower(w[2:])), '') ELSE term END AS part
        FROM u LEFT JOIN b ON token = part)
      SELECT m.video_id, coalesce(string_agg(part, '' ORDER BY spot), '') AS corrected FROM m LEFT JOIN x USING (video_id) GROUP BY m.video_id""",
    "year_detection": rf"""WITH {_MIS}, {_READ}, n AS (SELECT video_id, {_NORM} AS t FROM m), x AS (SELECT video_id, list_sort(list_distinct(regexp_extract_all(t, '19[7-9][0-9]|20[0-2][0-9]|2030'))) AS years FROM n),
      sp AS (SELECT DISTINCT video_id, unnest(regexp_extract_all(t, '[12zir][09onod][\p{{L}}\p{{N}}_]{{2}}')) AS span FROM n), spans AS (SELECT DISTINCT span FROM sp), e AS ({_EXPAND}),
      a AS (SELECT video_id, list_sort(list(DISTINCT year::VARCHAR)) AS y FROM sp JOIN e USING (span) GROUP BY video_id)
      SELECT x.video_id, array_to_string(years, ',') AS years, coalesce(array_to_string(list_filter(y, lambda q: NOT list_contains(years, q)), ','), '') AS ambiguous FROM x LEFT JOIN a USING (video_id)""",
    "year_expansion": f"WITH {_MIS}, {_READ}, spans AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[0-9a-z]{{4}}')) AS span FROM m) {_EXPAND}",
    "title_bigrams": f"""WITH n AS (SELECT video_id, list_filter(string_split({_NORM.replace('text', 'title')}, ' '), lambda x: x <> '') AS w FROM ({TITLES_SQL})),
      g AS (SELECT video_id, w, unnest(generate_series(1, len(w) - 1)) AS i FROM n) SELECT video_id, w[i] || ' ' || w[i + 1] AS bigram FROM g""",
    "repeat_collapse": r"""WITH t AS (SELECT item_id, text || ' ' || regexp_extract(text, '^[^.]*\.') || ' More follows' AS t FROM benchmark),
      s AS (SELECT item_id, list_transform(string_split(regexp_replace(t, '([.?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)) AS s FROM t), l AS (SELECT *, list_transform(s, lambda x: lower(x)) AS l FROM s),
      c AS (SELECT *, list_min(list_filter(generate_series(1, len(l)), lambda i: l[i] <> '' AND len(list_filter(l[:i - 1], lambda k: contains(k, l[i]) OR contains(l[i], k))) > 0)) AS again FROM l),
      j AS (SELECT item_id, array_to_string(s[:coalesce(again, len(s) + 1) - 1], ' ') AS j FROM c) SELECT item_id, CASE WHEN j = '' OR regexp_matches(j, '[.?]$') THEN j ELSE j || '.' END AS collapsed FROM j""",
    "path_columns": """SELECT page_id, url || '/chan/img-' || page_id || '.jpg' AS path, 'chan' AS channel, 'img-' || page_id AS video_id FROM pages""",
    "model_to_brand_inference": f"SELECT model, {_map(lexicon.MODEL_BRAND)}[model] AS brand FROM (SELECT unnest({list(lexicon.MODELS)}) AS model)",
}
CORRECTED_SQL = f"(WITH RECURSIVE {_MIS}, {_CORRECTED} SELECT video_id, text FROM corrected)"
ORACLE_SQL["ocr_corrected"] = f"SELECT video_id, text AS corrected FROM {CORRECTED_SQL}"
ORACLE_SQL["fuzzy_entities"] = entities_sql(f"(WITH {_MIS} SELECT * FROM m)")
