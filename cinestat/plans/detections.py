"""Grouped detections and the centres they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.operators import detections
from cinestat.operators.ranking import global_row_number
from cinestat.plans.registry import query, table

_BOXES_SQL = """
    o AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_tax) AS id, l_partkey,
      l_quantity * 4 AS x, l_tax * 2000 AS y, 32e0 + l_linenumber AS w, 32e0 + l_discount * 100 AS h FROM lineitem),
    p AS (SELECT a.l_partkey, a.id AS a, b.id AS b FROM o a JOIN o b ON a.l_partkey = b.l_partkey AND a.id <> b.id
      WHERE greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.x + a.w - b.x - b.w), abs(a.y + a.h - b.y - b.h)) <= 0.1e0 * (least(a.w, b.w) + least(a.h, b.h))),
    r(a, b) AS (SELECT id, id FROM o UNION SELECT r.a, p.b FROM r JOIN p ON p.a = r.b),
    c AS (SELECT a AS id, min(b) AS class FROM r GROUP BY a),
    g AS MATERIALIZED (SELECT l_partkey, class, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(w) AS w, avg(h) AS h FROM o JOIN c USING (id) GROUP BY l_partkey, class HAVING count(*) >= 3),
    k AS MATERIALIZED (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.l_partkey = g.l_partkey AND b.class <> g.class
      AND g.x >= b.x - 0.2e0 * b.w AND g.y >= b.y - 0.2e0 * b.h AND g.x + g.w <= b.x + b.w + 0.2e0 * b.w AND g.y + g.h <= b.y + b.h + 0.2e0 * b.h
      AND (b.n > greatest(3, g.n) OR g.n < 3)))
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes over the image of their part, with numbers of their own."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax"]
    li = table(spark, sf_dir, "lineitem").select(*order, "l_discount")
    return global_row_number(li, [F.col(c) for c in order], "id").select(
        "id", "l_partkey", (F.col("l_quantity") * 4).alias("x"), (F.col("l_tax") * 2000).alias("y"),
        (32.0 + F.col("l_linenumber")).alias("w"), (32.0 + F.col("l_discount") * 100).alias("h"))


@query(
    "grouped_detections",
    f"""WITH RECURSIVE {_BOXES_SQL}
    SELECT l_partkey, n, round(x, 5) AS x, round(y, 5) AS y, round(w, 5) AS w, round(h, 5) AS h FROM k""",
)
def grouped_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = detections.group_boxes(_boxes(spark, sf_dir), "l_partkey")
    return groups.select("l_partkey", "n", *[F.round(c, 5).alias(c) for c in detections.BOX])


@query(
    "located_centres",
    f"""WITH RECURSIVE {_BOXES_SQL},
    s AS (SELECT p_partkey AS l_partkey, p_size * 8e0 AS cx, 100e0 + p_size AS cy FROM part WHERE p_brand <> 'Brand#11'),
    d AS (SELECT *, sqrt(pow(x + w / 2 - 128, 2) + pow(y + h / 2 - 128, 2)) AS d FROM k),
    f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY d, x, y, w, h) AS rn FROM d) WHERE rn = 1),
    j AS (SELECT p_partkey AS l_partkey, s.cx, s.cy, coalesce(s.cx >= 0 AND s.cx < 256 AND s.cy >= 0 AND s.cy < 256, FALSE) AS inside,
      coalesce(f.d < 64, FALSE) AS hit, f.x + f.w / 2 AS fx, f.y + f.h / 2 AS fy
      FROM part LEFT JOIN s ON s.l_partkey = p_partkey LEFT JOIN f ON f.l_partkey = p_partkey)
    SELECT l_partkey, round(CASE WHEN inside THEN cx WHEN hit THEN fx ELSE 128 END, 5) AS cx, round(CASE WHEN inside THEN cy WHEN hit THEN fy ELSE 128 END, 5) AS cy,
      CASE WHEN inside THEN 'stored' WHEN hit THEN 'detected' ELSE 'default' END AS origin FROM j""",
)
def located_centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored centres of parts; missing ones and those outside the image are detected again."""
    part = table(spark, sf_dir, "part")
    stored = part.where("p_brand <> 'Brand#11'").select(
        F.col("p_partkey").alias("l_partkey"), (F.col("p_size") * 8.0).alias("cx"), (100.0 + F.col("p_size")).alias("cy"))
    found = detections.locate(part.select(F.col("p_partkey").alias("l_partkey")), stored, _boxes(spark, sf_dir), "l_partkey", 256.0, 256.0)
    return found.select("l_partkey", F.round("cx", 5).alias("cx"), F.round("cy", 5).alias("cy"), "origin")
