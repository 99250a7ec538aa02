"""Queries that hold predictions against labelled data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe import lexicon
from lumenframe.functions import text
from lumenframe.operators import evaluation, sampling
from lumenframe.sources import tables
from lumenframe.sources.tables import TITLES_SQL

ALPHAS, BETAS = (0.3, 0.5, 0.7, 1.0), (0.5, 1.0, 2.0)


def latest_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.latest(tables.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


def inner_anti_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reconcile(*tables.labelled_text(spark, sf_dir))


def micro_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.micro_scores(*tables.labelled_text(spark, sf_dir))


def per_video_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.misses(*tables.labelled_text(spark, sf_dir))
    return found.select("video_id", "entity", F.array_join("missed", ",").alias("missed"), F.array_join("wrong", ",").alias("wrong"))


def keyword_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, _ = tables.labelled_text(spark, sf_dir)
    long = truth.select("video_id", F.explode("keywords").alias("category", "words"))
    return long.select("video_id", "category", F.explode(text.canonical_set(F.col("words"), lexicon.KEYWORD_ALIASES)).alias("keyword"))


def corpus_cer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_rates(tables.text_pairs(spark, sf_dir)).select("mode", "n", "cer")


def corpus_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.error_rates(tables.text_pairs(spark, sf_dir)).select("mode", "n", "wer")


def grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination with scores measured on the lines of its share of orders, some missing, some tied; ranked, the
    winner first (G2, W5, A14)."""
    combos = evaluation.grid(spark, ALPHAS, BETAS)
    n = len(ALPHAS) * len(BETAS)
    lines = tables.table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % n).cast("int").alias("combo")).agg(
        F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 2).alias("brand_f1"),
        F.round(F.avg((F.col("l_linestatus") == "O").cast("double")), 2).alias("y"), F.round(F.avg("l_tax"), 4).alias("cer"),
    )
    scored = combos.join(lines, "combo", "left").withColumn("year_f1", F.when(F.col("combo") % 4 != 1, F.col("y")))
    ranked = evaluation.ranked_grid(scored).limit(len(ALPHAS) * len(BETAS))
    best = F.row_number().over(_order())
    return ranked.select("combo", "alpha", "beta", "tag", best.alias("place"))


def _order():
    from pyspark.sql import Window

    return Window.orderBy(F.coalesce("brand_f1", F.lit(0.0)).desc(), F.coalesce("year_f1", F.lit(0.0)).desc(), F.coalesce("cer", F.lit(1.0)), "combo")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen rows themselves."""
    e = tables.embeddings(spark, sf_dir).select("channel", "video_id")
    return sampling.stratified(e, F.col("channel") == 0, 10)


def _truth(shift: int) -> str:
    b, m, w = ["vw", "Chevy", "alfa", "kia", " "], ["CRV", "id.buzz", "civic"], ["electricos", "nuevas", "diesel", "mejores"]
    f = ["Nuevo", "estreno", "opinión"]
    return f"""SELECT video_id, [({b})[video_id % 5 + 1], ({b})[(video_id + {shift}) % 5 + 1]] AS brands, [({m})[video_id * {1 + shift} % 3 + 1]] AS models,
      [(2010 + video_id % {5 + shift})::VARCHAR] AS years, [({w})[(video_id + {shift} * (video_id % 3)) % 4 + 1]] AS words,
      CASE WHEN video_id % 4 = {shift} THEN [] ELSE [({f})[video_id % 3 + 1], ({f})[(video_id + {shift}) % 3 + 1]] END AS fresh FROM ({TITLES_SQL}) WHERE video_id % 11 <> {shift}"""


def _map(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


def _canon(column: str, table: dict[str, str]) -> str:
    return f"list_distinct(list_transform(list_filter({column}, lambda x: trim(x) <> ''), lambda x: coalesce({_map(table)}[lower(x)], lower(x))))"


def _long(side: str) -> str:
    return f"""SELECT video_id, 'brand' AS entity, {_canon('brands', lexicon.BRAND_ALIASES)} AS items FROM {side} UNION ALL SELECT video_id, 'model', {_canon('models', lexicon.MODEL_ALIASES)} FROM {side}
      UNION ALL SELECT video_id, 'year', years FROM {side} UNION ALL SELECT video_id, 'kw:powertrain', {_canon('words', lexicon.KEYWORD_ALIASES)} FROM {side}
      UNION ALL SELECT video_id, 'kw:freshness', {_canon('fresh', lexicon.KEYWORD_ALIASES)} FROM {side}"""


_SETS = f"""t AS ({_truth(0)}), p AS ({_truth(1)}), tl AS ({_long('t')}), pl AS ({_long('p')}),
e AS (SELECT video_id, entity, tl.items AS a, pl.items AS b FROM tl JOIN pl USING (video_id, entity))"""
_PAIR = """b AS (SELECT item_id, replace(text, 'ß', 's') AS r, upper(replace(replace(replace(text, 'ß', 's'), 'th', 't h'), 'e', '3')) AS h FROM benchmark),
c AS (SELECT 'strict' AS mode, trim(regexp_replace(r, '\\s+', ' ', 'g')) AS r, trim(regexp_replace(h, '\\s+', ' ', 'g')) AS h FROM b
  UNION ALL SELECT 'lenient', trim(regexp_replace(lower(strip_accents(r)), '\\s+', ' ', 'g')), trim(regexp_replace(lower(strip_accents(h)), '\\s+', ' ', 'g')) FROM b)"""

QUERIES = {
    f.__name__: f
    for f in (
        latest_row_per_key, inner_anti_reconcile, micro_prf, per_video_misses, keyword_unpivot, corpus_cer, corpus_wer, grid_rank, stratified_sample,
    )
}
ORACLE_SQL = {
    "latest_row_per_key": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "inner_anti_reconcile": f"""WITH t AS ({_truth(0)}), p AS ({_truth(1)})
      SELECT coalesce(t.video_id, p.video_id) AS video_id, CASE WHEN p.video_id IS NULL THEN 'missing' WHEN t.video_id IS NULL THEN 'unexpected' ELSE 'joined' END AS status FROM t FULL JOIN p USING (video_id)""",
    "micro_prf": f"""WITH {_SETS}, s AS (SELECT entity, sum(len(list_intersect(a, b)))::BIGINT AS tp, sum(len(list_filter(b, lambda x: NOT list_contains(a, x))))::BIGINT AS fp,
      sum(len(list_filter(a, lambda x: NOT list_contains(b, x))))::BIGINT AS fn FROM e GROUP BY entity),
      q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0 END AS r FROM s)
      SELECT entity, tp, fp, fn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1 FROM q""",
    "per_video_misses": f"""WITH {_SETS} SELECT video_id, entity, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS missed,
      array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(a, x))), ',') AS wrong FROM e""",
    "keyword_unpivot": f"""WITH t AS ({_truth(0)}) SELECT video_id, 'powertrain' AS category, unnest({_canon('words', lexicon.KEYWORD_ALIASES)}) AS keyword FROM t
      UNION ALL SELECT video_id, 'freshness', unnest({_canon('fresh', lexicon.KEYWORD_ALIASES)}) FROM t""",
    "corpus_cer": f"WITH {_PAIR} SELECT mode, count(*) AS n, round(sum(levenshtein_chars)::DOUBLE / sum(length(r)), 4) AS cer FROM (SELECT *, {{dist}} AS levenshtein_chars FROM c) GROUP BY mode",
    # Each distinct word of a pair as one character below 128; no pair of these texts has more.
    "corpus_wer": f"""WITH {_PAIR}, w AS (SELECT mode, string_split(r, ' ') AS rw, string_split(h, ' ') AS hw FROM c),
      v AS (SELECT *, list_distinct(list_concat(rw, hw)) AS voc FROM w),
      l AS (SELECT mode, len(rw) AS n, levenshtein(array_to_string(list_transform(rw, lambda x: chr(list_position(voc, x)::INT)), ''), array_to_string(list_transform(hw, lambda x: chr(list_position(voc, x)::INT)), '')) AS e FROM v)
      SELECT mode, count(*) AS n, round(sum(e)::DOUBLE / sum(n), 4) AS wer FROM l GROUP BY mode""",
    "grid_rank": """WITH c AS (SELECT a.i * 3 + b.i AS combo, a.v AS alpha, b.v AS beta FROM (VALUES (0, 0.3), (1, 0.5), (2, 0.7), (3, 1.0)) a(i, v), (VALUES (0, 0.5), (1, 1.0), (2, 2.0)) b(i, v))
      , l AS (SELECT l_orderkey % 12 AS combo, round(avg((l_returnflag = 'R')::INT::DOUBLE), 2) AS b, round(avg((l_linestatus = 'O')::INT::DOUBLE), 2) AS y, round(avg(l_tax), 4) AS cer FROM lineitem GROUP BY 1)
      SELECT combo::INT AS combo, alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, 'a' || alpha || '_b' || beta AS tag,
        row_number() OVER (ORDER BY coalesce(b, 0) DESC, CASE WHEN combo % 4 <> 1 THEN coalesce(y, 0) ELSE 0 END DESC, coalesce(cer, 1), combo)::INT AS place FROM c LEFT JOIN l USING (combo)""",
    "stratified_sample": """SELECT label AS channel, vec_id AS video_id FROM embeddings
      QUALIFY label = 0 OR row_number() OVER (PARTITION BY label ORDER BY md5('42#' || vec_id), vec_id) <= 10""",
}
# DuckDB's levenshtein counts bytes; accents are the only longer characters here, so texts are
# compared after a one-to-one replacement of each by a byte that no text holds.
ORACLE_SQL["corpus_cer"] = ORACLE_SQL["corpus_cer"].replace(
    "{dist}", "levenshtein({0}, {1})".format(*(f"translate({x}, 'éèêàçñóíúáüöäßÉÈÊÀÇÑÓÍÚÁÜÖÄ', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(11)||chr(12)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27)||chr(28)||chr(29)||chr(30))" for x in "rh"))
)
