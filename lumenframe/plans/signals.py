"""Queries over boxes, sequences, intervals and samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import boxes, scores, sequences, vectors
from lumenframe.operators import sampling, tensors
from lumenframe.sources import tables
from lumenframe.sources.tables import BOX

CHARSET = "abcdef "


def _kept(found: DataFrame) -> DataFrame:
    return found.select("image_id", F.array_join(F.transform("kept", lambda b: b["box_id"].cast("string")), ",").alias("kept"))


def box_nms_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return _kept(b.select("image_id", boxes.by_area(F.col("boxes"), BOX).alias("kept")))


def box_nms_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return _kept(b.select("image_id", boxes.by_score(F.col("boxes"), BOX, 0.3, score_over=0.1, most=3).alias("kept")))


def box_nms_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    return _kept(b.select("image_id", boxes.by_score(F.col("boxes"), BOX, 0.3, classes=True).alias("kept")))


def box_first_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    by_id = F.array_sort("boxes", lambda x, y: F.when(x["box_id"] < y["box_id"], -1).when(x["box_id"] > y["box_id"], 1).when(x < y, -1).when(x > y, 1).otherwise(0))
    return _kept(b.select("image_id", boxes.first_come(by_id, BOX).alias("kept")))


def box_unclip_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = tables.boxes(spark, sf_dir).select("image_id", F.explode("boxes").alias("b")).select("image_id", "b.*")
    grown = boxes.unclipped(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(120), F.lit(110))
    back = boxes.rescaled(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"), F.lit(0.8), F.lit(120), F.lit(110))
    return one.select("image_id", "box_id", *[c.alias(f"grown_{n}") for n, c in grown.items()], back.alias("r")).select(
        "image_id", "box_id", "grown_x", "grown_y", "grown_w", "grown_h", F.col("r.x").alias("x"), F.col("r.y").alias("y"), F.col("r.w").alias("w"), F.col("r.h").alias("h")
    )


def box_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir)
    order = boxes.reading_order(F.col("boxes"))
    return b.select(
        "image_id", F.size("boxes").alias("n"), boxes.largest_ratio(F.col("boxes"), F.lit(640 * 640)).alias("largest"),
        F.array_max(F.transform("boxes", lambda x: x["score"])).alias("best"), F.array_join(F.transform(order, lambda x: x["box_id"].cast("string")), ",").alias("reading_order"),
    )


def box_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from centre form to corners (N9), and their scores scaled to 0 to 1 over all."""
    one = tables.boxes(spark, sf_dir).select("image_id", F.explode("boxes").alias("b")).select("image_id", "b.*")
    ends = one.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = scores.min_max(F.col("score"), F.col("low"), F.col("high"))
    corners = boxes.corners(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return one.crossJoin(F.broadcast(ends)).select("image_id", "box_id", corners.alias("c"), F.round(scaled, 6).alias("scaled")).select("image_id", "box_id", "c.*", "scaled")


def tile_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text grows with the length, so a small file of parts makes much of it: its rows are dealt over all tasks,
    and each text is cut from that of the longest. A task has its rows by length, so that each text begins as the one
    before does, and a writer that looks back that far keeps little of it (a subquery, as a join would drop the sort)."""
    lengths = tables.table(spark, sf_dir, "part").select((F.col("p_partkey") * 7).cast("int").alias("length"))
    longest = lengths.agg(F.coalesce(F.max("length"), F.lit(0)).alias("length"))
    regular = longest.select(F.concat(F.array_join(boxes.tile_starts(F.col("length")).cast("array<string>"), ","), F.lit(",")).cast("binary").alias("regular"))
    dealt = lengths.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).sortWithinPartitions("length")
    return dealt.select("length", boxes.tile_text(F.col("length"), regular.scalar()).alias("starts"))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, labels): small class numbers by line, as a recogniser's frames."""
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.floor(F.col("l_quantity") / 7)).cast("int").alias("c"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "c"))), lambda x: x["c"])
    return rows.groupBy(F.col("l_orderkey").alias("image_id")).agg(ordered.alias("labels"))


def ctc_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labels(spark, sf_dir).select("image_id", sequences.ctc_text(F.col("labels"), CHARSET).alias("decoded"))


def repetition_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: i * 0.5)
    found = _labels(spark, sf_dir).select("image_id", sequences.penalised(logits, F.col("labels"), window=4, exempt=(3,)).alias("p"))
    return found.select("image_id", F.posexplode("p").alias("token", "logit"))


def tta_geomean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of each order's line shares."""
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.lit(0).alias("t"), F.col("l_linenumber").alias("class_id"), "l_quantity", "l_tax")
    views = rows.select("key", "t", "class_id", F.lit(0).alias("view"), (F.col("l_quantity") / 50).alias("p")).union(rows.select("key", "t", "class_id", F.lit(1), (F.col("l_tax") + 0.01)))
    return sampling.geometric_mean(views).withColumn("p", F.round("p", 6))


def array_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.boxes(spark, sf_dir).select("image_id", F.transform("boxes", lambda x: x["score"]).alias("s"))
    peaks = vectors.peak_scaled(F.col("s"))
    return b.select("image_id", F.arrays_zip(vectors.softmax(F.col("s")).alias("p"), peaks.alias("k")).alias("z")).select("image_id", F.posexplode("z").alias("at", "z")).select("image_id", "at", F.round("z.p", 6).alias("p"), F.round("z.k", 6).alias("scaled"))


def busy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open intervals run to the end of the year that the events are of."""
    return sampling.busy_time(tables.intervals(spark, sf_dir), F.unix_millis(F.lit("2025-01-01 00:00:00").cast("timestamp")))


def duty_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.col("event_id") * 10).alias("updated_ms"), (F.col("event_id") * 3 + F.col("event_id") % 5).alias("busy_ms"))
    return sampling.duty_cycle(rows).withColumn("duty", F.round("duty", 9))


def chunk_5s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as sound of 10 samples a second, in chunks of one second; the last is padded."""
    signal = tables.embeddings(spark, sf_dir).select(F.col("video_id").alias("key"), F.col("embedding").alias("samples"))
    found = sampling.chunks(signal, rate=10, seconds=1)
    return found.select("key", "chunk", F.size("samples").alias("n"), F.round(F.aggregate("samples", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.element_at("samples", -1).alias("last"))


def global_sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", (F.col("l_discount") * 12).alias("score"))
    return sampling.global_sigmoid(rows).withColumn("score", F.round("score", 6))


def log_mel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log-mel energies of tones whose pitch follows the part number."""
    filters = np.eye(80, 201)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            mels = [tensors.log_mel(np.sin(np.arange(1600) * (0.01 + k % 50 / 100)), filters) for k in part["key"]]
            yield pd.DataFrame({"key": part["key"], "frames": [m.shape[1] for m in mels], "mean": [round(float(m.mean(dtype=float)), 6) for m in mels]})

    return tables.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key")).mapInPandas(run, "key long, frames int, mean double")


def image_pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel features of images drawn from the embeddings."""
    names = (
        "aspect_ratio", "megapixels", "mean_hue", "mean_sat", "mean_value", "std_hue", "std_sat", "std_value", "saturation_high_ratio", "brightness_mean", "dark_pixel_ratio",
        "bright_pixel_ratio", "warm_color_ratio", "cool_color_ratio", "unique_color_ratio", "contrast_std", "edge_density", "edge_density_top_third", "edge_density_bottom_third",
        "high_edge_rows_ratio",
    )

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for v in part["embedding"]:
                pixels = np.clip(np.outer(v, v) * 4000 + 128, 0, 255).astype(np.uint8)
                found = tensors.pixel_features(np.stack([pixels, pixels.T, 255 - pixels], axis=2))
                rows.append([float(found[n]) for n in names])
            yield pd.DataFrame(rows, columns=list(names)).assign(video_id=part["video_id"].to_numpy())[["video_id", *names]]

    return tables.embeddings(spark, sf_dir).mapInPandas(run, "video_id long, " + ", ".join(f"{n} double" for n in names))


_BOX = "SELECT l_orderkey AS image_id, l_partkey % 97 AS x, l_suppkey % 89 AS y, floor(l_quantity * 2 + 20)::INT AS w, floor(l_quantity + 20)::INT AS h, round(l_discount * 10, 4) AS score, l_linenumber % 2 AS class_id, l_linenumber AS box_id FROM lineitem"
_IOU = """(greatest(least(z.x + z.w, b.x + b.w) - greatest(z.x, b.x), 0) * greatest(least(z.y + z.h, b.y + b.h) - greatest(z.y, b.y), 0))::DOUBLE
  / (z.w * z.h + b.w * b.h - greatest(least(z.x + z.w, b.x + b.w) - greatest(z.x, b.x), 0) * greatest(least(z.y + z.h, b.y + b.h) - greatest(z.y, b.y), 0))"""


def _nms(order: str, suppressed: str, where: str = "true", most: int | None = None) -> str:
    """Greedy suppression as a recursion over places: each box is kept unless a kept one suppresses it."""
    cut = f"[1:{most}]" if most else ""
    fields = "{'x': x, 'y': y, 'w': w, 'h': h, 'class_id': class_id, 'box_id': box_id}"
    return f"""WITH RECURSIVE box AS ({_BOX}), s AS (SELECT image_id, {fields} AS b, row_number() OVER (PARTITION BY image_id ORDER BY {order}) AS k FROM box WHERE {where}),
      f AS (SELECT image_id, 0::BIGINT AS k, []::STRUCT(x BIGINT, y BIGINT, w INTEGER, h INTEGER, class_id INTEGER, box_id INTEGER)[] AS kept FROM (SELECT DISTINCT image_id FROM box)
        UNION ALL SELECT f.image_id, s.k, CASE WHEN len(list_filter(kept, lambda z: {suppressed})) > 0 THEN kept ELSE list_append(kept, b) END FROM f JOIN s ON s.image_id = f.image_id AND s.k = f.k + 1)
      SELECT image_id, array_to_string(list_transform(max_by(kept, k){cut}, lambda q: q.box_id), ',') AS kept FROM f GROUP BY image_id"""


# An image's rows and columns; beyond its border stands the nearest pixel for gradients, 0 for magnitudes.
_ROW, _COLUMN = "OVER (PARTITION BY id, y ORDER BY x)", "OVER (PARTITION BY id, x ORDER BY y)"
_beside = lambda c, way, line: f"coalesce({way}({c}) {line}, {c})"
_digits = lambda x, n: f"round_even({x} * 1e{n}, 0) / 1e{n}"
_PIXELS = f"""WITH RECURSIVE v AS (SELECT vec_id AS id, embedding AS e, len(embedding) AS n FROM embeddings),
      px AS (SELECT id, n, y, x, floor(least(greatest(e[y] * e[x] * 4000::FLOAT + 128::FLOAT, 0), 255))::DOUBLE AS b FROM v, LATERAL (SELECT unnest(generate_series(1, n)) AS y), LATERAL (SELECT unnest(generate_series(1, n)) AS x)),
      bgr AS (SELECT *, b AS g, 255 - b AS r FROM px),
      ends AS (SELECT *, greatest(b, g, r) AS val, least(b, g, r) AS low, round_even(0.114::DOUBLE * b + 0.587::DOUBLE * g + 0.299::DOUBLE * r, 0) AS gray FROM bgr),
      turn AS (SELECT *, CASE WHEN val = low THEN 0::DOUBLE WHEN val = r THEN (g - b) / (val - low) WHEN val = g THEN 2 + (b - r) / (val - low) ELSE 4 + (r - g) / (val - low) END * 60 AS h FROM ends),
      hsv AS (SELECT *, round_even(CASE WHEN h < 0 THEN h + 360 ELSE h END / 2, 0) % 180 AS hue, CASE WHEN val > 0 THEN round_even((val - low) * 255 / val, 0) ELSE 0 END AS sat FROM turn),
      across AS (SELECT id, y, x, {_beside("gray", "lead", _ROW)} - {_beside("gray", "lag", _ROW)} AS d, {_beside("gray", "lag", _ROW)} + 2 * gray + {_beside("gray", "lead", _ROW)} AS s FROM hsv),
      sobel AS (SELECT id, y, x, {_beside("d", "lag", _COLUMN)} + 2 * d + {_beside("d", "lead", _COLUMN)} AS dx, {_beside("s", "lead", _COLUMN)} - {_beside("s", "lag", _COLUMN)} AS dy FROM across),
      mag AS (SELECT *, abs(dx) + abs(dy) AS m, abs(dy) / greatest(abs(dx), 1e-12::DOUBLE) AS steep FROM sobel),
      sides AS (SELECT *, lag(m, 1, 0) {_ROW} AS w, lead(m, 1, 0) {_ROW} AS z FROM mag),
      eight AS (SELECT *, lag(m, 1, 0) {_COLUMN} AS up, lead(m, 1, 0) {_COLUMN} AS down, lag(w, 1, 0) {_COLUMN} AS uw, lead(z, 1, 0) {_COLUMN} AS dz, lag(z, 1, 0) {_COLUMN} AS uz, lead(w, 1, 0) {_COLUMN} AS dw FROM sides),
      peaks AS (SELECT id, y, x, m FROM eight WHERE m > 80 AND CASE WHEN steep < 0.4142::DOUBLE THEN m > w AND m >= z WHEN steep > 2.4142::DOUBLE THEN m > up AND m >= down WHEN dx * dy > 0 THEN m > uw AND m >= dz ELSE m > uz AND m >= dw END),
      near AS (SELECT a.i AS dy, c.i AS dx FROM range(-1, 2) a(i), range(-1, 2) c(i)),
      edge AS (SELECT id, y, x FROM peaks WHERE m > 180 UNION SELECT p.id, p.y, p.x FROM edge e CROSS JOIN near o JOIN peaks p ON p.id = e.id AND p.y = e.y + o.dy AND p.x = e.x + o.dx),
      marked AS (SELECT hsv.*, (edge.id IS NOT NULL)::INT AS on_edge FROM hsv LEFT JOIN edge ON edge.id = hsv.id AND edge.y = hsv.y AND edge.x = hsv.x),
      lines AS (SELECT id, y, avg(on_edge) AS mean FROM marked GROUP BY id, y), dense AS (SELECT id, mean > 2 * avg(mean) OVER (PARTITION BY id) AS over_twice FROM lines),
      high AS (SELECT id, avg(over_twice::INT) AS high FROM dense GROUP BY id)
      SELECT id AS video_id, 1.0::DOUBLE AS aspect_ratio, round(any_value(n * n) / 1e6, 3) AS megapixels, avg(hue) AS mean_hue, avg(sat) AS mean_sat, avg(val) AS mean_value, stddev_pop(hue) AS std_hue,
      stddev_pop(sat) AS std_sat, stddev_pop(val) AS std_value, avg((sat > 128)::INT) AS saturation_high_ratio, avg(val) AS brightness_mean, avg((val < 64)::INT) AS dark_pixel_ratio,
      avg((val > 192)::INT) AS bright_pixel_ratio, avg((hue < 30 OR hue > 150)::INT) AS warm_color_ratio, avg((hue BETWEEN 90 AND 150)::INT) AS cool_color_ratio,
      {_digits("count(DISTINCT floor(b / 8) * 1024 + floor(g / 8) * 32 + floor(r / 8)) / any_value(n * n)", 6)} AS unique_color_ratio, stddev_pop(gray) AS contrast_std, {_digits("avg(on_edge)", 5)} AS edge_density,
      {_digits("avg(on_edge) FILTER (y <= n // 3)", 5)} AS edge_density_top_third, {_digits("avg(on_edge) FILTER (y > n - n // 3)", 5)} AS edge_density_bottom_third,
      {_digits("any_value(high)", 4)} AS high_edge_rows_ratio FROM marked JOIN high USING (id) GROUP BY id"""
# A discrete Fourier transform by its definition, over the 50 pitches there are.
_MELS = """WITH tone AS (SELECT DISTINCT p_partkey % 50 AS pitch FROM part), s AS (SELECT pitch, i, sin(i * (0.01::DOUBLE + pitch / 100.0::DOUBLE)) AS v FROM tone, range(1600) r(i)),
      f AS (SELECT t, i, CASE WHEN t * 160 + i < 200 THEN 200 - t * 160 - i WHEN t * 160 + i > 1799 THEN 3398 - t * 160 - i ELSE t * 160 + i - 200 END AS at, 0.5 - 0.5 * cos(2 * pi() * i / 400) AS hann FROM range(10) a(t), range(400) b(i)),
      w AS (SELECT pitch, t, f.i, v * hann AS v FROM f JOIN s ON s.i = f.at), turn AS (SELECT i, k, cos(2 * pi() * (i * k % 400) / 400) AS c, sin(2 * pi() * (i * k % 400) / 400) AS s FROM range(400) a(i), range(80) b(k)),
      p AS (SELECT pitch, t, k, log10(greatest(sum(v * c) ** 2 + sum(v * s) ** 2, 1e-10::DOUBLE)) AS db FROM w JOIN turn USING (i) GROUP BY pitch, t, k),
      m AS (SELECT pitch, count(DISTINCT t)::INT AS frames, round(avg(((greatest(db, top - 8) + 4) / 4)::FLOAT::DOUBLE), 6) AS mean FROM (SELECT *, max(db) OVER (PARTITION BY pitch) AS top FROM p) GROUP BY pitch)
      SELECT p_partkey AS key, frames, mean FROM part JOIN m ON pitch = p_partkey % 50"""
_LABELS = "lab AS (SELECT l_orderkey AS image_id, list(floor(l_quantity / 7)::INT ORDER BY l_linenumber, floor(l_quantity / 7)) AS labels FROM lineitem GROUP BY l_orderkey)"
QUERIES = {
    f.__name__: f
    for f in (
        box_nms_area, box_nms_score, box_nms_class, box_first_come, box_unclip_rescale, box_ratios, box_corners, tile_positions, ctc_greedy,
        repetition_penalty, tta_geomean, array_softmax, busy_union, duty_cycle, chunk_5s, global_sigmoid, log_mel, image_pixel_stats,
    )
}
_TIES = "x, y, w, h, score, class_id, box_id"
ORACLE_SQL = {
    "log_mel": _MELS,
    "image_pixel_stats": _PIXELS,
    "box_nms_area": _nms(f"w * h DESC, {_TIES}", f"{_IOU} >= 0.5"),
    "box_nms_score": _nms(f"score DESC, {_TIES}", f"{_IOU} > 0.3", "score > 0.1", 3),
    "box_nms_class": _nms(f"score DESC, {_TIES}", f"z.class_id = b.class_id AND {_IOU} > 0.3"),
    "box_first_come": _nms(f"box_id, {_TIES}", f"{_IOU} > 0.3"),
    "box_unclip_rescale": f"""WITH box AS ({_BOX}), g AS (SELECT *, greatest(2, round_even(w * 0.12::DOUBLE, 0)::INT) AS dx, greatest(2, round_even(h * 0.12::DOUBLE, 0)::INT) AS dy,
      greatest(0, round_even(x / 0.8::DOUBLE, 0)::INT) AS l, greatest(0, round_even(y / 0.8::DOUBLE, 0)::INT) AS t, least(120, round_even((x + w) / 0.8::DOUBLE, 0)::INT) AS r, least(110, round_even((y + h) / 0.8::DOUBLE, 0)::INT) AS u FROM box)
      SELECT image_id, box_id, greatest(x - dx, 0) AS grown_x, greatest(y - dy, 0) AS grown_y, least(120 - greatest(x - dx, 0), w + 2 * dx) AS grown_w, least(110 - greatest(y - dy, 0), h + 2 * dy) AS grown_h,
      CASE WHEN r > l AND u > t THEN l END AS x, CASE WHEN r > l AND u > t THEN t END AS y, CASE WHEN r > l AND u > t THEN r - l END AS w, CASE WHEN r > l AND u > t THEN u - t END AS h FROM g""",
    "box_ratios": f"""WITH box AS ({_BOX}) SELECT image_id, count(*)::INT AS n, round(max(w * h) / 409600.0::DOUBLE, 5) AS largest, max(score) AS best,
      string_agg(box_id::VARCHAR, ',' ORDER BY y, x, w, h, score, class_id, box_id) AS reading_order FROM box GROUP BY image_id""",
    "box_corners": f"""WITH box AS ({_BOX}) SELECT image_id, box_id, x - w / 2.0::DOUBLE AS x1, y - h / 2.0::DOUBLE AS y1, x + w / 2.0::DOUBLE AS x2, y + h / 2.0::DOUBLE AS y2,
      round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS scaled FROM box""",
    "tile_positions": """SELECT p_partkey * 7 AS length, CASE WHEN p_partkey * 7 <= 512 THEN '0' ELSE array_to_string(list_distinct_sorted, ',') END AS starts FROM (
      SELECT p_partkey, list_sort(list_distinct(list_append(generate_series(0, greatest(p_partkey * 7 - 512, 0), 384), greatest(p_partkey * 7 - 512, 0)))) AS list_distinct_sorted FROM part)""",
    "ctc_greedy": f"""WITH {_LABELS}, u AS (SELECT image_id, unnest(labels) AS c, generate_subscripts(labels, 1) AS i FROM lab), p AS (SELECT *, lag(c) OVER (PARTITION BY image_id ORDER BY i) AS before FROM u)
      SELECT image_id, coalesce(string_agg(substr('{CHARSET}', c, 1), '' ORDER BY i) FILTER (c BETWEEN 1 AND {len(CHARSET)} AND c IS DISTINCT FROM before), '') AS decoded FROM p GROUP BY image_id""",
    "repetition_penalty": f"""WITH {_LABELS}, t AS (SELECT image_id, labels, unnest(generate_series(0, 9)) AS token FROM lab)
      SELECT image_id, token::INT AS token, CASE WHEN token <> 3 AND list_contains(labels[-4:], token::INT) THEN token * 0.5::DOUBLE / 1.5::DOUBLE ELSE token * 0.5::DOUBLE END AS logit FROM t""",
    "tta_geomean": """WITH v AS (SELECT l_orderkey AS key, 0 AS t, l_linenumber AS class_id, l_quantity / 50 AS p FROM lineitem UNION ALL SELECT l_orderkey, 0, l_linenumber, l_tax + 0.01::DOUBLE FROM lineitem),
      g AS (SELECT key, t, class_id, exp(avg(ln(p + 1e-9::DOUBLE))) AS g FROM v GROUP BY ALL) SELECT key, t, class_id, round(g / sum(g) OVER (PARTITION BY key, t), 6) AS p FROM g""",
    "array_softmax": f"""WITH box AS ({_BOX}), o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {_TIES}) - 1 AS pos, max(abs(score)) OVER (PARTITION BY image_id) AS peak FROM box)
      SELECT image_id, pos::INT AS at, round(exp(score) / sum(exp(score)) OVER (PARTITION BY image_id), 6) AS p, round(CASE WHEN peak > 1e-6 THEN score * (0.9::DOUBLE / peak) ELSE score END, 6) AS scaled FROM o""",
    "busy_union": """WITH i AS (SELECT user_id AS key, epoch_us(ts::TIMESTAMP) // 1000 AS s, least(coalesce(epoch_us(ts::TIMESTAMP) // 1000 + floor(abs(value) * 1000)::BIGINT, 1735689600000), 1735689600000) AS e FROM events), r AS (SELECT * FROM i WHERE e > s),
      b AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
      n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e) AS island FROM b), u AS (SELECT key, max(e) - min(s) AS len FROM n GROUP BY key, island)
      SELECT key, busy_ms, summed_ms, n FROM (SELECT key, sum(len)::BIGINT AS busy_ms FROM u GROUP BY key) JOIN (SELECT key, sum(e - s)::BIGINT AS summed_ms, count(*) AS n FROM r GROUP BY key) USING (key)""",
    "duty_cycle": """WITH r AS (SELECT user_id AS key, event_id * 10 AS updated_ms, event_id * 3 + event_id % 5 AS busy_ms FROM events)
      SELECT *, round((busy_ms - lag(busy_ms) OVER w)::DOUBLE / (updated_ms - lag(updated_ms) OVER w), 9) AS duty FROM r WINDOW w AS (PARTITION BY key ORDER BY updated_ms)""",
    "chunk_5s": """WITH c AS (SELECT vec_id AS key, embedding[:600] AS embedding, unnest(generate_series(0, (least(len(embedding), 600) - 1) // 10)) AS chunk FROM embeddings)
      SELECT key, chunk::INT AS chunk, 10 AS n, round(list_sum(list_transform(embedding[chunk * 10 + 1:chunk * 10 + 10], lambda x: x::DOUBLE)), 5) AS total, coalesce(embedding[chunk * 10 + 10], 0)::FLOAT AS last FROM c""",
    "global_sigmoid": """WITH r AS (SELECT l_orderkey AS key, l_linenumber, l_discount * 12 AS score FROM lineitem), a AS (SELECT *, min(score) OVER k < 0 OR max(score) OVER k > 1 AS applied FROM r WINDOW k AS (PARTITION BY key))
      SELECT key, l_linenumber, round(CASE WHEN applied THEN 1 / (1 + exp(-score)) ELSE score END, 6) AS score, applied FROM a""",
}
