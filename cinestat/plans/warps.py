"""Images warped by matrices of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinestat.functions import geometry as g
from cinestat.operators import augment, pixels as px_ops
from cinestat.plans.geometry import PX_SQL, images
from cinestat.plans.registry import query

SIDE = 8


def _sampled(matrix: str) -> str:
    """Pixels of images warped by the inverse matrix (a, b, c; d, e, f) that the CTE ``matrix`` gives for each ``vec_id``."""
    return f"""o AS (SELECT vec_id, x, y, a * x + b * y + c AS sx, d * x + e * y + f AS sy FROM {matrix}
      CROSS JOIN (SELECT unnest(range({SIDE})) AS x) CROSS JOIN (SELECT unnest(range({SIDE})) AS y)),
    t AS (SELECT o.vec_id, o.x, o.y, sum(p.v * (1 - abs(sx - p.x)) * (1 - abs(sy - p.y))) AS v FROM o LEFT JOIN px p
      ON p.vec_id = o.vec_id AND abs(sx - p.x) < 1 AND abs(sy - p.y) < 1 GROUP BY o.vec_id, o.x, o.y)
    SELECT vec_id, y::INTEGER AS y, x::INTEGER AS x, round(coalesce(v, 0), 6) + 0e0 AS v FROM t"""


def _drawn(k: int, seed: int = 42) -> str:
    return f"(('0x' || substr(md5('{seed}:' || vec_id || ':{k}'), 1, 8))::BIGINT::DOUBLE / 4294967296e0)"


def _pixels(df: DataFrame, px: Column) -> DataFrame:
    return px_ops.explode_pixels(df.select("vec_id", px.alias("px")), "vec_id", "px", SIDE).withColumn("v", F.round("v", 6) + 0.0)


_HALF = SIDE / 2 - 0.5


@query(
    "augmented_images",
    f"""WITH {PX_SQL},
    u AS (SELECT vec_id, exp((2 * {_drawn(0)} - 1) * ln(1.3e0)) AS s, exp((2 * {_drawn(1)} - 1) * ln(1.6e0)) AS z, radians(floor({_drawn(2)} * 360)) AS r,
      radians(floor({_drawn(3)} * 80) - 40) AS k, floor({_drawn(4)} * 20) - 10 AS tx, floor({_drawn(5)} * 20) - 10 AS ty, {_drawn(6)} < 0.5e0 AS mirror FROM embeddings),
    l AS (SELECT *, s / z * cos(r) AS a0, -sin(r + k) / (z * s) AS b0, s / z * sin(r) AS c0, cos(r + k) / (z * s) AS d0 FROM u),
    h AS (SELECT *, tx + {_HALF} - a0 * {_HALF} - b0 * {_HALF} AS mx, ty + {_HALF} - c0 * {_HALF} - d0 * {_HALF} AS my, a0 * d0 - b0 * c0 AS det FROM l),
    i AS (SELECT *, d0 / det AS ia, -b0 / det AS ib, -c0 / det AS ic, a0 / det AS id FROM h),
    m AS (SELECT vec_id, CASE WHEN mirror THEN -ia ELSE ia END AS a, ib AS b, -(ia * mx + ib * my) + CASE WHEN mirror THEN {SIDE - 1} * ia ELSE 0 END AS c,
      CASE WHEN mirror THEN -ic ELSE ic END AS d, id AS e, -(ic * mx + id * my) + CASE WHEN mirror THEN {SIDE - 1} * ic ELSE 0 END AS f FROM i),
    {_sampled('m')}""",
)
def augmented_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zoom, stretch, rotation, shear, shift and mirroring, drawn from each image's key."""
    return _pixels(images(spark, sf_dir), augment.affine_of(F.col("px"), F.col("vec_id"), SIDE, SIDE, 42))


@query(
    "rotated_images",
    f"""WITH {PX_SQL}, u AS (SELECT vec_id, radians(floor({_drawn(0)} * 60) - 30) AS r FROM embeddings),
    m AS (SELECT vec_id, cos(r) AS a, sin(r) AS b, (1 - cos(r)) * {_HALF} - sin(r) * {_HALF} AS c,
      -sin(r) AS d, cos(r) AS e, sin(r) * {_HALF} + (1 - cos(r)) * {_HALF} AS f FROM u), {_sampled('m')}""",
)
def rotated_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(images(spark, sf_dir), augment.rotated_of(F.col("px"), F.col("vec_id"), SIDE, SIDE, 42, 30))


@query(
    "shifted_images",
    f"""WITH {PX_SQL}, m AS (SELECT vec_id, 1 AS a, 0 AS b, -trunc((2 * {_drawn(0)} - 1) * 0.4e0 * {SIDE}) AS c,
      0 AS d, 1 AS e, -trunc((2 * {_drawn(1)} - 1) * 0.3e0 * {SIDE}) AS f FROM embeddings), {_sampled('m')}""",
)
def shifted_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(images(spark, sf_dir), augment.shifted_of(F.col("px"), F.col("vec_id"), SIDE, SIDE, 42, 0.3, 0.4))


#: Two points of the long axis of each image, and the centres marked along it.
_AXIS_SQL = f"""
    g AS (SELECT vec_id, (('0x' || substr(md5('ax:' || vec_id), 1, 2))::INTEGER % 8)::DOUBLE AS x1, 0.5e0 AS y1,
      (('0x' || substr(md5('ax:' || vec_id), 3, 2))::INTEGER % 8)::DOUBLE AS x2, 6.5e0 AS y2, array_agg_x AS xs FROM
      (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS array_agg_x FROM embeddings)),
    n AS (SELECT *, atan2(y1 - y2, x1 - x2) AS r FROM g)
"""


def _axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.md5(F.concat(F.lit("ax:"), F.col("vec_id").cast("string")))
    end = lambda k: (F.conv(F.substring(digest, k, 2), 16, 10).cast("int") % 8).cast("double")
    df = images(spark, sf_dir).select("vec_id", "px", end(1).alias("x1"), F.lit(0.5).alias("y1"), end(3).alias("x2"), F.lit(6.5).alias("y2"))
    return df.withColumn("angle", F.degrees(F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2"))))


@query(
    "normalised_views",
    f"""WITH {PX_SQL}, {_AXIS_SQL},
    m AS (SELECT vec_id, cos(r) AS a, -sin(r) AS b, (1 - cos(r)) * 4 + sin(r) * 4 AS c, sin(r) AS d, cos(r) AS e, (1 - cos(r)) * 4 - sin(r) * 4 AS f FROM n),
    {_sampled('m')}""",
)
def normalised_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image turned so that its axis lies level, around the middle pixel."""
    df = _axes(spark, sf_dir)
    back = g.rotation_about(-F.col("angle"), F.lit(SIDE / 2), F.lit(SIDE / 2))
    return _pixels(df, px_ops.warp_affine(F.col("px"), SIDE, SIDE, back, SIDE, SIDE))


@query(
    "view_boxes",
    f"""WITH {_AXIS_SQL},
    t AS (SELECT *, -sin(r) * x1 + cos(r) * y1 + sin(r) * 4 + (1 - cos(r)) * 4 AS ty, -sin(r) * x2 + cos(r) * y2 + sin(r) * 4 + (1 - cos(r)) * 4 AS ly FROM n),
    h AS (SELECT *, abs(ty - ly) AS height, least(ty, ly) AS lo FROM t),
    c AS (SELECT *, list_sort(list_transform(range(3), lambda i: cos(r) * (4 + 8 * xs[CAST(i + 1 AS INTEGER)]) + sin(r) * (2 + 2 * i) + (1 - cos(r)) * 4 - sin(r) * 4))[2] AS mid FROM h)
    SELECT vec_id, round(degrees(r), 6) AS angle, round(mid - 0.5e0 * height, 5) AS x, round(lo - least(0.2e0 * height, 20), 5) AS y,
      round(height, 5) AS w, round(height + 2 * least(0.2e0 * height, 20), 5) AS h FROM c""",
)
def view_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box of each turned view: as wide as its axis is high, around the middle one of its centres, with a margin."""
    df = _axes(spark, sf_dir)
    turn = g.rotation_about(F.col("angle"), F.lit(SIDE / 2), F.lit(SIDE / 2))
    ends = [g.affine(turn, F.col(f"x{k}"), F.col(f"y{k}"))[1] for k in (1, 2)]
    centres = F.array(*[g.affine(turn, 4 + 8 * F.get("px", i), F.lit(2.0 + 2 * i))[0] for i in range(3)])
    t = df.select("vec_id", "angle", ends[0].alias("ty"), ends[1].alias("ly"), F.get(F.array_sort(centres), 1).alias("mid"))
    height = F.abs(F.col("ty") - F.col("ly"))
    margin = F.least(0.2 * height, F.lit(20.0))
    box = {"x": F.col("mid") - 0.5 * height, "y": F.least("ty", "ly") - margin, "w": height, "h": height + 2 * margin}
    return t.select("vec_id", F.round("angle", 6).alias("angle"), *[F.round(v, 5).alias(k) for k, v in box.items()])
