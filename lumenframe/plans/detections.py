"""Queries over decoded detector heads, masks and tiles, the embeddings' numbers standing in for tensors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import boxes, decoding
from lumenframe.plans.signals import _BOX, _IOU, _kept
from lumenframe.sources import tables
from lumenframe.sources.tables import BOX

STRIDE, GRID = 32, 20
PROTO, FACTOR = 8, 4
TILE, OVERLAP = 8, 2


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, x, y, v): each embedding as the head of a cell with its centre."""
    e = tables.embeddings(spark, sf_dir).select(F.col("video_id").alias("cell"), F.col("embedding").alias("v"))
    return e.select("cell", decoding.centre(F.col("cell") % GRID, STRIDE).alias("x"), decoding.centre(F.floor(F.col("cell") / GRID) % GRID, STRIDE).alias("y"), "v")


def distance_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes from distributions over bins."""
    c = _cells(spark, sf_dir)
    sharp = F.transform("v", lambda x: x.cast("double") * 10)
    found = c.select("cell", decoding.corners_around(F.col("x"), F.col("y"), decoding.side_distances(sharp, STRIDE)).alias("b"))
    return found.select("cell", *[F.round(f"b.{k}", 5).alias(k) for k in ("x1", "y1", "x2", "y2")])


def anchor_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces of two anchors a cell, scores over the threshold only."""
    c = _cells(spark, sf_dir)
    part = lambda a, n: F.slice("v", a, n)
    found = c.select("cell", F.inline(decoding.anchor_faces(part(1, 2), part(3, 8), part(11, 20), F.col("x"), F.col("y"), STRIDE, 0.1)))
    return found.select("cell", "anchor", *[F.round(f"box.{k}", 4).alias(k) for k in ("x1", "y1", "x2", "y2")], F.round(F.element_at("landmarks", 3)["x"], 4).alias("nose_x"), F.round(F.element_at("landmarks", 5)["y"], 4).alias("mouth_y"))


def pose_keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joints of each cell's person."""
    found = _cells(spark, sf_dir).select("cell", F.posexplode(decoding.keypoints(F.col("v"), F.col("x"), F.col("y"), STRIDE)).alias("joint", "k"))
    return found.select("cell", "joint", F.round("k.x", 4).alias("x"), F.round("k.y", 4).alias("y"), F.round("k.score", 6).alias("score"))


def head_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as the tensors of heads: whose are complete."""
    p = tables.table(spark, sf_dir, "part")
    pick = lambda values, by: F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))
    tensors = p.select(F.floor(F.col("p_partkey") / 5).alias("image_id"), F.struct(pick((8, 16, 32, 64), F.col("p_size")).alias("stride"), pick((64, 51, 32, 80, 1), F.col("p_partkey")).alias("channels")).alias("t"))
    return tensors.groupBy("image_id").agg(F.array_sort(F.collect_list("t")).alias("t")).select("image_id", decoding.head_error(F.col("t")).alias("error"))


def instance_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of cells as instances: coefficients times prototypes, scaled up, cut to a box (N15). The prototypes are one
    map of a fixed size, the first embeddings."""
    e = tables.embeddings(spark, sf_dir)
    proto = e.filter(F.col("video_id") < PROTO * PROTO).agg(F.array_sort(F.collect_list(F.struct("video_id", F.slice("embedding", 1, 32).alias("p")))).alias("proto"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cells = _cells(spark, sf_dir).select("cell", F.slice("v", 33, 32).alias("coeff"), *[F.element_at("v", i).alias(f"s{i}") for i in (1, 2, 3)])
    both = cells.crossJoin(F.broadcast(proto))
    low = F.transform("proto", lambda p: 1 / (1 + F.exp(-20 * dot(p["p"], F.col("coeff")))))
    full = both.select("cell", "s1", "s2", "s3", low.alias("low")).select("cell", "s1", "s2", "s3", decoding.upsampled(F.col("low"), PROTO, FACTOR).alias("m"))
    size = PROTO * FACTOR
    left, top = F.col("cell") % 9, F.col("cell") % 7
    inside = lambda i: (i % size >= left) & (i % size < left + 16) & (F.floor(i / size) >= top) & (F.floor(i / size) < top + 20)
    on = F.filter(F.transform("m", lambda x, i: (F.round(x, 9) > 0.5) & inside(i)), lambda x: x)
    scores = F.array("s1", "s2", "s3")
    return full.select("cell", (F.array_position(scores, F.array_max(scores)) - 1).cast("int").alias("class_id"), F.size(on).alias("pixels"))


def painted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells of an 8 by 8 grid show each box of an image."""
    grid = tables.boxes(spark, sf_dir).select("image_id", F.explode(decoding.painted(F.col("boxes"), 8, 20)).alias("id"))
    return grid.groupBy("image_id", "id").agg(F.count("*").alias("cells"))


def blended_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as overlapping tiles of one brightness each, averaged with weights that fall off at their edges."""
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), ((F.col("l_linenumber") - 1) * (TILE - OVERLAP)).alias("left"), "l_quantity")
    pixels = lines.select("image_id", "left", "l_quantity", F.explode(F.sequence(F.lit(0), F.lit(TILE - 1))).alias("i"))
    w = decoding.tile_weight(F.col("i"), TILE, OVERLAP)
    summed = pixels.groupBy("image_id", (F.col("left") + F.col("i")).alias("x")).agg(F.sum(F.col("l_quantity") * w).alias("v"), F.sum(w).alias("w"))
    return summed.select("image_id", F.col("x").cast("int").alias("x"), F.round(F.col("v") / F.greatest("w", F.lit(1e-6)), 6).alias("value"))


def face_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether landmarks can be aligned: the template with each embedding's noise, some of it collapsed."""
    spread = F.when(F.col("cell") % 5 == 0, 0.1).otherwise(1.0)
    point = lambda i, t: F.struct((t[0] * spread + F.element_at("v", 2 * i + 1) * 40).alias("x"), (t[1] * spread + F.element_at("v", 2 * i + 2) * 40).alias("y"))
    points = F.array(*[point(i, t) for i, t in enumerate(decoding.FACE_TEMPLATE)])
    found = decoding.alignment(_cells(spark, sf_dir).select("cell", points.alias("points")))
    return found.select("cell", F.round("eyes", 4).alias("eyes"), F.round("residual", 4).alias("residual"), "error")


def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the image and, halved, of the image at twice its size; overlaps by area go."""
    b = tables.boxes(spark, sf_dir)
    twice = F.transform("boxes", lambda x: x.withField("x", x["x"] * 2 + x["box_id"]).withField("w", x["w"] * 2 - 1).withField("h", x["h"]).withField("box_id", x["box_id"] + 100))
    return _kept(b.select("image_id", boxes.by_area(F.concat("boxes", decoding.halved(twice)).cast(BOX), BOX).alias("kept")))


def score_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over a score, and those that reach it."""
    over = lambda test: F.size(F.filter("boxes", test)).alias
    return tables.boxes(spark, sf_dir).select("image_id", over(lambda b: b["score"] > 0.3)("n_over"), over(lambda b: b["score"] >= 0.3)("n_reached"))


_CELL = f"c AS (SELECT vec_id AS cell, (vec_id % {GRID} + 0.5::DOUBLE) * {STRIDE} AS x, ((vec_id // {GRID}) % {GRID} + 0.5::DOUBLE) * {STRIDE} AS y, embedding AS v FROM embeddings)"
_UNION = f"""SELECT * FROM ({_BOX}) UNION ALL SELECT image_id, (x * 2 + box_id) // 2, y // 2, greatest((w * 2 - 1) // 2, 1)::INT, greatest(h // 2, 1)::INT, score, class_id, box_id + 100 FROM ({_BOX})"""
_PT = ", ".join(f"[{t[0]} * s + v[{2 * i + 1}]::DOUBLE * 40, {t[1]} * s + v[{2 * i + 2}]::DOUBLE * 40]" for i, t in enumerate(decoding.FACE_TEMPLATE))
_TT = ", ".join(f"[{t[0]}, {t[1]}]" for t in decoding.FACE_TEMPLATE)

QUERIES = {
    f.__name__: f
    for f in (
        distance_boxes, anchor_faces, pose_keypoints, head_errors, instance_masks, painted_ids, blended_tiles, face_alignment, box_union, score_thresholds,
    )
}
ORACLE_SQL = {
    "distance_boxes": f"""WITH {_CELL}, s AS (SELECT cell, x, y, side, v[side * 16 + 1:side * 16 + 16] AS l FROM c, (SELECT unnest([0, 1, 2, 3]) AS side)),
      e AS (SELECT *, list_transform(l, lambda q: exp(q::DOUBLE * 10)) AS p FROM s),
      d AS (SELECT cell, x, y, side, list_inner_product(p, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]::DOUBLE[]) / list_sum(p) * {STRIDE} AS far FROM e)
      SELECT cell, round(any_value(x) - max(far) FILTER (side = 0), 5) AS x1, round(any_value(y) - max(far) FILTER (side = 1), 5) AS y1,
        round(any_value(x) + max(far) FILTER (side = 2), 5) AS x2, round(any_value(y) + max(far) FILTER (side = 3), 5) AS y2 FROM d GROUP BY cell""",
    "anchor_faces": f"""WITH {_CELL}, a AS (SELECT cell, x, y, v, unnest([0, 1]) AS anchor FROM c)
      SELECT cell, anchor, round(x - v[4 * anchor + 3]::DOUBLE * {STRIDE}, 4) AS x1, round(y - v[4 * anchor + 4]::DOUBLE * {STRIDE}, 4) AS y1, round(x + v[4 * anchor + 5]::DOUBLE * {STRIDE}, 4) AS x2,
        round(y + v[4 * anchor + 6]::DOUBLE * {STRIDE}, 4) AS y2, round(x + v[10 * anchor + 15]::DOUBLE * {STRIDE}, 4) AS nose_x, round(y + v[10 * anchor + 20]::DOUBLE * {STRIDE}, 4) AS mouth_y
      FROM a WHERE v[anchor + 1]::DOUBLE > 0.1::DOUBLE""",
    "pose_keypoints": f"""WITH {_CELL}, k AS (SELECT *, unnest(generate_series(0, 16)) AS joint FROM c)
      SELECT cell, joint::INT AS joint, round({STRIDE} * (2 * v[3 * joint + 1]::DOUBLE - 0.5::DOUBLE) + x, 4) AS x, round({STRIDE} * (2 * v[3 * joint + 2]::DOUBLE - 0.5::DOUBLE) + y, 4) AS y,
        round(1 / (1 + exp(-v[3 * joint + 3]::DOUBLE)), 6) AS score FROM k""",
    "head_errors": """WITH t AS (SELECT p_partkey // 5 AS image_id, ([8, 16, 32, 64])[p_size % 4 + 1] AS stride, ([64, 51, 32, 80, 1])[p_partkey % 5 + 1] AS channels FROM part),
      r AS (SELECT *, CASE channels WHEN 64 THEN 'box' WHEN 51 THEN 'kpt' WHEN 32 THEN 'coeff' ELSE 'score' END AS role FROM t),
      n AS (SELECT image_id, stride || ':' || role AS k, count(*) AS n FROM r WHERE stride < 64 GROUP BY ALL),
      g AS (SELECT image_id, min(k) FILTER (n > 1) AS twice FROM n GROUP BY image_id),
      m AS (SELECT image_id, list_filter([8, 16, 32], lambda s: NOT list_contains(list(stride), s)) AS missing FROM r GROUP BY image_id)
      SELECT image_id, CASE WHEN twice IS NOT NULL THEN 'two tensors for ' || twice WHEN len(missing) > 0 THEN 'missing strides ' || array_to_string(missing, ',') END AS error FROM m LEFT JOIN g USING (image_id)""",
    "instance_masks": f"""WITH {_CELL}, pr AS (SELECT vec_id AS q, embedding[1:32]::DOUBLE[] AS p FROM embeddings WHERE vec_id < 64),
      low AS (SELECT cell, list(1 / (1 + exp(-20 * list_inner_product(p, v[33:64]::DOUBLE[]))) ORDER BY q) AS m FROM c, pr GROUP BY cell),
      ax AS (SELECT i, greatest(least((i + 0.5::DOUBLE) / 4 - 0.5::DOUBLE, 7), 0) AS f FROM (SELECT unnest(generate_series(0, 31)) AS i)),
      en AS (SELECT i, floor(f)::INT AS a, least(floor(f)::INT + 1, 7) AS b, f - floor(f) AS u FROM ax),
      px AS (SELECT cell, (m[8 * r.a + s.a + 1] * (1 - s.u) + m[8 * r.a + s.b + 1] * s.u) * (1 - r.u) + (m[8 * r.b + s.a + 1] * (1 - s.u) + m[8 * r.b + s.b + 1] * s.u) * r.u AS z, r.i AS row, s.i AS col FROM low, en r, en s),
      n AS (SELECT cell, count(*) FILTER (round(z, 9) > 0.5 AND col >= cell % 9 AND col < cell % 9 + 16 AND row >= cell % 7 AND row < cell % 7 + 20) AS pixels FROM px GROUP BY cell)
      SELECT cell, (list_position(v[1:3], list_max(v[1:3])) - 1)::INT AS class_id, pixels FROM n JOIN c USING (cell)""",
    "painted_ids": f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x, y, w, h, score, class_id, box_id) AS place FROM ({_BOX})),
      g AS (SELECT r, s, (s + 0.5::DOUBLE) * 20 AS px, (r + 0.5::DOUBLE) * 20 AS py FROM (SELECT unnest(generate_series(0, 7)) AS r), (SELECT unnest(generate_series(0, 7)) AS s)),
      t AS (SELECT image_id, r, s, arg_max(place, (score, place)) FILTER (x <= px AND px < x + w AND y <= py AND py < y + h) AS id FROM b, g GROUP BY image_id, r, s)
      SELECT image_id, coalesce(id, 0)::INT AS id, count(*) AS cells FROM t GROUP BY ALL""",
    "blended_tiles": f"""WITH p AS (SELECT l_orderkey AS image_id, (l_linenumber - 1) * 6 + i AS x, l_quantity AS q, CASE WHEN i < 2 THEN i / 2.0::DOUBLE WHEN i >= 6 THEN (7 - i) / 2.0::DOUBLE ELSE 1 END AS w FROM lineitem, (SELECT unnest(generate_series(0, 7)) AS i))
      SELECT image_id, x::INT AS x, round(sum(q * w) / greatest(sum(w), 1e-6::DOUBLE), 6) AS value FROM p GROUP BY image_id, x""",
    "face_alignment": f"""WITH {_CELL}, q AS (SELECT cell, v, CASE WHEN cell % 5 = 0 THEN 0.1::DOUBLE ELSE 1 END AS s FROM c), p AS (SELECT cell, [{_PT}]::DOUBLE[][] AS a, [{_TT}]::DOUBLE[][] AS b FROM q),
      u AS (SELECT cell, unnest(a) AS a, unnest(b) AS b FROM p), z AS (SELECT cell, a[1] - avg(a[1]) OVER w AS x, a[2] - avg(a[2]) OVER w AS y, b[1] - avg(b[1]) OVER w AS u, b[2] - avg(b[2]) OVER w AS v FROM u WINDOW w AS (PARTITION BY cell)),
      f AS (SELECT cell, sum(x * u + y * v) / sum(x * x + y * y) AS co, sum(x * v - y * u) / sum(x * x + y * y) AS si FROM z GROUP BY cell),
      r AS (SELECT cell, sqrt(avg(pow(co * x - si * y - u, 2) + pow(si * x + co * y - v, 2))) AS residual FROM z JOIN f USING (cell) GROUP BY cell),
      e AS (SELECT cell, sqrt(pow(a[2][1] - a[1][1], 2) + pow(a[2][2] - a[1][2], 2)) AS eyes FROM p)
      SELECT cell, round(eyes, 4) AS eyes, round(residual, 4) AS residual, CASE WHEN eyes < 10 THEN 'landmarks too small' WHEN residual > 12 THEN 'landmarks do not fit' END AS error FROM e JOIN r USING (cell)""",
    "box_union": f"""WITH RECURSIVE box AS ({_UNION}), s AS (SELECT image_id, {{'x': x, 'y': y, 'w': w, 'h': h, 'box_id': box_id}} AS b, row_number() OVER (PARTITION BY image_id ORDER BY w * h DESC, x, y, w, h, score, class_id, box_id) AS k FROM box),
      f AS (SELECT image_id, 0::BIGINT AS k, []::STRUCT(x BIGINT, y BIGINT, w INTEGER, h INTEGER, box_id INTEGER)[] AS kept FROM (SELECT DISTINCT image_id FROM box)
        UNION ALL SELECT f.image_id, s.k, CASE WHEN len(list_filter(kept, lambda z: {_IOU} >= 0.5)) > 0 THEN kept ELSE list_append(kept, b) END FROM f JOIN s ON s.image_id = f.image_id AND s.k = f.k + 1)
      SELECT image_id, array_to_string(list_transform(max_by(kept, k), lambda q: q.box_id), ',') AS kept FROM f GROUP BY image_id""",
    "score_thresholds": f"SELECT image_id, (count(*) FILTER (score > 0.3))::INT AS n_over, (count(*) FILTER (score >= 0.3))::INT AS n_reached FROM ({_BOX}) GROUP BY image_id",
}
