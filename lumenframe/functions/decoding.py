"""Column expressions that decode detector heads, one row per grid cell, and what is made of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import vectors

BINS = 16
JOINTS = 17
#: Roles of a head's tensors by their number of channels; any other number is a score tensor.
ROLES = {64: "box", 51: "kpt", 32: "coeff"}
STRIDES = (8, 16, 32)
#: Where five landmarks lie in an aligned face of 112 by 112 pixels.
FACE_TEMPLATE = ((38.2946, 51.6963), (73.5318, 51.5014), (56.0252, 71.7366), (41.5493, 92.3655), (70.7299, 92.2041))


def centre(column: Column, stride) -> Column:
    """A cell's centre in pixels."""
    return (column + 0.5) * stride


def side_distances(logits: Column, stride) -> Column:
    """The four distances of a cell to its box's sides: means of softmaxed bins, in pixels."""
    mean = lambda p: F.aggregate(F.transform(p, lambda x, i: x * i), F.lit(0.0), lambda s, x: s + x)
    sides = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice(logits, k * BINS + 1, F.lit(BINS)))
    return F.transform(sides, lambda s: mean(vectors.softmax(F.transform(s, lambda x: x.cast("double")))) * stride)


def corners_around(x: Column, y: Column, sides: Column) -> Column:
    """Corners from a centre and its distances to left, top, right and bottom."""
    at = lambda i: F.element_at(sides, i)
    return F.struct((x - at(1)).alias("x1"), (y - at(2)).alias("y1"), (x + at(3)).alias("x2"), (y + at(4)).alias("y2"))


def anchor_faces(scores: Column, boxes: Column, landmarks: Column, x: Column, y: Column, stride, score_over: float = 0.5) -> Column:
    """Faces of a cell's two anchors whose score exceeds the threshold: corners and five landmarks, offsets being in strides."""
    scaled = lambda a, n, size: F.transform(F.slice(a, n * size + 1, F.lit(size)), lambda v: v.cast("double") * stride)
    point = lambda a, k: F.struct((x + F.element_at(a, 2 * k + 1)).alias("x"), (y + F.element_at(a, 2 * k + 2)).alias("y"))
    each = F.transform(F.sequence(F.lit(0), F.lit(1)), lambda n: F.struct(
        n.alias("anchor"), F.element_at(scores, n + 1).cast("double").alias("score"), corners_around(x, y, scaled(boxes, n, 4)).alias("box"),
        F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: point(scaled(landmarks, n, 10), k)).alias("landmarks"),
    ))
    return F.filter(each, lambda f: f["score"] > score_over)


def keypoints(values: Column, x: Column, y: Column, stride) -> Column:
    """Seventeen joints of a cell: place and sigmoid of the score."""
    v = lambda k, i: F.element_at(values, 3 * k + i).cast("double")
    place = lambda raw, c: stride * (2 * raw - 0.5) + c
    return F.transform(F.sequence(F.lit(0), F.lit(JOINTS - 1)), lambda k: F.struct(
        place(v(k, 1), x).alias("x"), place(v(k, 2), y).alias("y"), (1 / (1 + F.exp(-v(k, 3)))).alias("score")
    ))


def head_error(heads: Column) -> Column:
    """Why the tensors (stride, channels) of one image are no complete head, or null (N12): a role twice, or a stride missing."""
    role = lambda h: F.coalesce(*[F.when(h["channels"] == c, F.lit(r)) for c, r in ROLES.items()], F.lit("score"))
    known = F.filter(heads, lambda h: h["stride"].isin(*STRIDES))
    roles = F.transform(known, lambda h: F.concat(h["stride"].cast("string"), F.lit(":"), role(h)))
    twice = F.array_sort(F.filter(F.array_distinct(roles), lambda r: F.size(F.filter(roles, lambda q: q == r)) > 1))
    missing = F.array_except(F.array(*map(F.lit, STRIDES)), F.transform(known, lambda h: h["stride"].cast("int")))
    return F.when(F.size(twice) > 0, F.concat(F.lit("two tensors for "), F.element_at(twice, 1))).when(
        F.size(missing) > 0, F.concat(F.lit("missing strides "), F.array_join(missing.cast("array<string>"), ","))
    )


def upsampled(values: Column, side: int, factor: int) -> Column:
    """A square map, row by row, at ``factor`` times its size, sampled between pixel centres."""
    size = side * factor

    def ends(i: Column) -> tuple[Column, Column, Column]:
        at = F.least(F.greatest((i + 0.5) / factor - 0.5, F.lit(0.0)), F.lit(float(side - 1)))
        low = F.floor(at).cast("int")
        return low, F.least(low + 1, F.lit(side - 1)), at - low

    def pixel(p: Column) -> Column:
        (top, bottom, v), (left, right, u) = ends(F.floor(p / size)), ends(p % size)
        at = lambda r, c: F.element_at(values, r * side + c + 1)
        row = lambda r: at(r, left) * (1 - u) + at(r, right) * u
        return row(top) * (1 - v) + row(bottom) * v

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pixel)


def painted(boxes: Column, side: int, cell: int) -> Column:
    """For each cell of a grid, row by row, 1 + the place of the strongest box over its centre, 0 where none is; of equals the
    later one (N16). ``boxes`` has x, y, w, h, score."""
    order = lambda a, b: F.when(a["score"] < b["score"], -1).when(a["score"] > b["score"], 1).otherwise(a["place"] - b["place"])
    placed = F.array_sort(F.transform(boxes, lambda b, i: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"), b["score"].alias("score"), i.alias("place"))), order)

    def paint(p: Column) -> Column:
        px, py = (p % side + 0.5) * cell, (F.floor(p / side) + 0.5) * cell
        inside = lambda b: (b["x"] <= px) & (px < b["x"] + b["w"]) & (b["y"] <= py) & (py < b["y"] + b["h"])
        return F.aggregate(placed, F.lit(0), lambda now, b: F.when(inside(b), b["place"] + 1).otherwise(now))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), paint)


def alignment(faces: DataFrame, points: str = "points", least_eyes: float = 10, most_residual: float = 12) -> DataFrame:
    """Adds eyes, residual and error for five landmarks (array of x, y) against the template: the distance between the eyes, the
    root mean square left by the best similarity, and why they cannot be aligned, or null (N22).

    Step by step, so that no sum is written out more than once.
    """
    n = len(FACE_TEMPLATE)
    p = lambda i, f: F.element_at(points, i + 1)[f].cast("double")
    t = [sum(v[k] for v in FACE_TEMPLATE) / n for k in (0, 1)]
    b = [(v[0] - t[0], v[1] - t[1]) for v in FACE_TEMPLATE]
    total = lambda terms: sum(terms[1:], terms[0])
    mean = {f"_{f}": total([p(i, f) for i in range(n)]) / n for f in "xy"}
    a = [(p(i, "x") - F.col("_x"), p(i, "y") - F.col("_y")) for i in range(n)]
    sums = {
        "_power": total([x * x + y * y for x, y in a]), "_cos": total([x * u + y * v for (x, y), (u, v) in zip(a, b)]),
        "_sin": total([x * v - y * u for (x, y), (u, v) in zip(a, b)]),
    }
    turn = {"_c": F.when(F.col("_power") > 0, F.col("_cos") / F.col("_power")), "_s": F.when(F.col("_power") > 0, F.col("_sin") / F.col("_power"))}
    c, s = F.col("_c"), F.col("_s")
    left = total([F.pow(c * x - s * y - u, 2) + F.pow(s * x + c * y - v, 2) for (x, y), (u, v) in zip(a, b)])
    eyes = F.sqrt(F.pow(p(1, "x") - p(0, "x"), 2) + F.pow(p(1, "y") - p(0, "y"), 2))
    found = faces.withColumns(mean).withColumns(sums).withColumns(turn).withColumns({"eyes": eyes, "residual": F.sqrt(left / n)})
    error = F.when(F.col("eyes") < least_eyes, "landmarks too small").when(F.col("residual").isNull() | (F.col("residual") > most_residual), "landmarks do not fit")
    return found.withColumn("error", error).drop(*mean, *sums, *turn)


def halved(boxes: Column) -> Column:
    """Boxes found in an image of twice the size, in the original's pixels."""
    half = lambda v: F.floor(v / 2).cast("int")
    return F.transform(boxes, lambda b: b.withField("x", half(b["x"])).withField("y", half(b["y"])).withField("w", F.greatest(half(b["w"]), F.lit(1))).withField("h", F.greatest(half(b["h"]), F.lit(1))))


def tile_weight(at: Column, size: int, overlap: int) -> Column:
    """Weight of a place in a tile, falling off over ``overlap`` at both ends."""
    return F.when(at < overlap, at / overlap).when(at >= size - overlap, (size - 1 - at) / overlap).otherwise(1.0)
