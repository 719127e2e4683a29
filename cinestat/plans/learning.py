"""Fitted models and per-image detectors on the given tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.functions import hog, shapes
from cinestat.models import regress
from cinestat.operators import detections, keyed, pixels as px_ops, ranking, shape_regression
from cinestat.plans.geometry import PX_SQL, images
from cinestat.plans.registry import query, table
from cinestat.plans.tabular import phase_table
from cinestat.session import cut_lineage, kept

FOLDS_SQL = """
    k AS (SELECT o_orderkey, o_totalprice / 1000 AS y, o_custkey % 97 + o_totalprice / 2000 AS x FROM orders),
    f AS (SELECT *, ((row_number() OVER (ORDER BY o_orderkey) - 1) % 10)::INTEGER AS fold FROM k)
"""


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_totalprice") / 1000).alias("label"),
        (F.col("o_custkey") % 97 + F.col("o_totalprice") / 2000).alias("x"),
    )
    return ranking.group_folds(o, "o_orderkey", 10)


@query(
    "out_of_fold_regression",
    f"""WITH {FOLDS_SQL}, m AS (SELECT a.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a0
      FROM (SELECT DISTINCT fold FROM f) a JOIN f ON f.fold != a.fold GROUP BY a.fold)
    SELECT o_orderkey, fold, round(a0 + b * x, 3) AS prediction FROM f JOIN m USING (fold)""",
)
def out_of_fold_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = regress.linear_out_of_fold(_folded(spark, sf_dir), ["x"])
    return pred.select("o_orderkey", "fold", F.round("prediction", 3).alias("prediction"))


@query(
    "ridge_out_of_fold",
    f"""WITH {FOLDS_SQL}, z AS (SELECT *, o_orderkey % 53 AS w FROM f),
    m AS (SELECT a.fold, avg(x) AS mx, avg(w) AS mw, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(w) AS sw, corr(x, w) AS r,
      covar_pop(x, y) / stddev_pop(x) AS cx, covar_pop(w, y) / stddev_pop(w) AS cw
      FROM (SELECT DISTINCT fold FROM z) a JOIN z ON z.fold != a.fold GROUP BY a.fold)
    SELECT o_orderkey, fold, round(my + (1.1e0 * cx - r * cw) / (1.21e0 - r * r) * (x - mx) / sx
      + (1.1e0 * cw - r * cx) / (1.21e0 - r * r) * (w - mw) / sw, 3) AS prediction FROM z JOIN m USING (fold)""",
)
def ridge_out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = _folded(spark, sf_dir).withColumn("w", (F.col("o_orderkey") % 53).cast("double"))
    pred = regress.linear_out_of_fold(folded, ["x", "w"], alpha=0.1)
    return pred.select("o_orderkey", "fold", F.round("prediction", 3).alias("prediction"))


@query(
    "linear_stack",
    """
    WITH p AS (SELECT l_orderkey AS k, sum(l_extendedprice) / 1000 AS a, sum(l_quantity) AS b FROM lineitem GROUP BY l_orderkey),
    t AS (SELECT k, a, b, o_totalprice / 1000 AS y, substr(md5('5:' || k), 1, 8) < '33333333' AS test FROM p JOIN orders ON o_orderkey = k),
    s AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_,
          avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM t WHERE NOT test),
    c AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM s)
    SELECT k AS l_orderkey, round(my + ca * (a - ma) + cb * (b - mb), 3) AS prediction FROM t, c WHERE test
    """,
)
def linear_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.sum("l_extendedprice") / 1000).alias("a"), F.sum("l_quantity").alias("b")
    )
    y = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1000).alias("label"))
    t = p.join(y, "l_orderkey").withColumn("test", ranking.seeded_below(5, 0.2, "l_orderkey"))
    model = regress.fit(t.where(~F.col("test")), ["a", "b"], regress.linear())
    return model.transform(t.where("test")).select("l_orderkey", F.round("prediction", 3).alias("prediction"))


FEATURES = ["v_min", "v_max", "v_min_cpr", "v_max_cpr", "mean_sys", "mean_dias", "is_diastole"]


# Rows of a task that grows trees; it holds them in memory.
TREE_ROWS = 500_000


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phase table, in as many parts as its size needs: adaptive execution sizes them by what is shuffled, not by what trees hold."""
    rows = phase_table(spark, sf_dir)
    parts = math.ceil(2 * table(spark, sf_dir, "orders").count() / TREE_ROWS)  # two rows an order at most
    return rows.repartition(parts, "l_orderkey", "is_diastole") if parts > 1 else rows


@query("boosted_ensemble")
def boosted_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of boosted trees and a ridge model, every row predicted by models of the other half of the orders."""
    rows = cut_lineage(_phases(spark, sf_dir).withColumn("half", ranking.seeded_below(9, 0.5, "l_orderkey")))
    parts = []
    for train, test in (("half", "not half"), ("not half", "half")):
        models = [regress.fit(rows.where(train), FEATURES, f) for f in (regress.boosted_trees(depth=5, trees=10), regress.ridge())]
        parts.append(regress.ensemble_mean(models, rows.where(test), ["l_orderkey", "is_diastole"]))
    return parts[0].unionByName(parts[1])


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = regress.fit(_phases(spark, sf_dir), FEATURES, regress.boosted_trees(depth=4, trees=5))
    return regress.relative_importance(model, FEATURES, spark)


def _large(spark: SparkSession, sf_dir: str, side: int = 32) -> DataFrame:
    """Embeddings as images of the detector's window size, intensities in [0, 1]."""
    big = images(spark, sf_dir).select("vec_id", "label", px_ops.rescale_minmax(F.col("px")).alias("px"))
    return big.select("vec_id", "label", px_ops.resize_bilinear(F.col("px"), 8, 8, side, side).alias("px"))


_HOG_SQL = f"""{PX_SQL}, mm AS (SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS r FROM px WINDOW w AS (PARTITION BY vec_id)),
    ax AS (SELECT o, greatest((o + 0.5e0) / 4 - 0.5e0, 0) AS c FROM (SELECT unnest(range(32)) AS o)),
    k AS (SELECT o, floor(c) AS c0, least(floor(c) + 1, 7) AS c1, c - floor(c) AS f FROM ax),
    wide AS (SELECT vec_id, y, k.o AS x, sum(r * (CASE WHEN mm.x = c0 THEN 1 - f ELSE 0 END + CASE WHEN mm.x = c1 THEN f ELSE 0 END)) AS v
      FROM mm JOIN k ON mm.x = c0 OR mm.x = c1 GROUP BY vec_id, y, k.o),
    big AS MATERIALIZED (SELECT vec_id, k.o AS y, x, sum(v * (CASE WHEN wide.y = c0 THEN 1 - f ELSE 0 END + CASE WHEN wide.y = c1 THEN f ELSE 0 END)) AS v
      FROM wide JOIN k ON wide.y = c0 OR wide.y = c1 GROUP BY vec_id, k.o, x),
    -- The gradient at an edge is 0: both neighbours are the same pixel, mirrored.
    gr AS (SELECT vec_id, y, x, CASE WHEN x IN (0, 31) THEN 0 ELSE lead(v) OVER h - lag(v) OVER h END AS gx,
      CASE WHEN y IN (0, 31) THEN 0 ELSE lead(v) OVER u - lag(v) OVER u END AS gy FROM big
      WINDOW h AS (PARTITION BY vec_id, y ORDER BY x), u AS (PARTITION BY vec_id, x ORDER BY y)),
    po AS (SELECT vec_id, y, x, sqrt(gx * gx + gy * gy) AS m, (CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + pi() ELSE atan2(gy, gx) END) * 9 / pi() - 0.5e0 AS p FROM gr),
    vo AS (SELECT vec_id, y, x, (floor(p)::INTEGER + 18 + o.o) % 9 AS bin, m * CASE WHEN o.o = 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS v FROM po, (VALUES (0), (1)) o(o)),
    bl AS (SELECT vec_id, i, j, y - 8 * i AS ty, x - 8 * j AS tx, bin, v FROM vo, (SELECT unnest(range(3)) AS i) bi, (SELECT unnest(range(3)) AS j) bj
      WHERE y BETWEEN 8 * i AND 8 * i + 15 AND x BETWEEN 8 * j AND 8 * j + 15),
    sh AS (SELECT vec_id, i, j, bin, v * exp(-((ty - 7.5e0) * (ty - 7.5e0) + (tx - 7.5e0) * (tx - 7.5e0)) / 32) AS v,
      least(greatest(1 - ((ty + 0.5e0) / 8 - 0.5e0), 0), 1) AS fy, least(greatest(1 - ((tx + 0.5e0) / 8 - 0.5e0), 0), 1) AS fx FROM bl),
    ce AS (SELECT vec_id, i, j, a.a * 18 + b.b * 9 + bin AS slot, sum(v * CASE WHEN a.a = 0 THEN fy ELSE 1 - fy END * CASE WHEN b.b = 0 THEN fx ELSE 1 - fx END) AS v
      FROM sh, (VALUES (0), (1)) a(a), (VALUES (0), (1)) b(b) GROUP BY ALL),
    n1 AS (SELECT * REPLACE (least(v / (sqrt(sum(v * v) OVER w) + 3.6e0), 0.05e0) AS v) FROM ce WINDOW w AS (PARTITION BY vec_id, i, j)),
    n2 AS (SELECT * REPLACE (v / (sqrt(sum(v * v) OVER w) + 1e-3) AS v) FROM n1 WINDOW w AS (PARTITION BY vec_id, i, j))
    SELECT vec_id, ((i * 3 + j) * 36 + slot)::INTEGER AS i, round(v, 6) AS v FROM n2"""


@query("gradient_histograms", f"WITH {_HOG_SQL}")
def gradient_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = hog.descriptors(_large(spark, sf_dir).select("vec_id", "px"), "px", "d")
    return d.select("vec_id", F.posexplode("d").alias("i", "v")).withColumn("v", F.round("v", 6))


@query("window_detector")
def window_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector of the odd classes, trained on all windows and run over larger images."""
    windows = hog.descriptors(_large(spark, sf_dir), "px", "d")
    samples = cut_lineage(windows.select("d", (F.col("label") % 2).alias("y")))
    weights, bias = regress.train_detector(samples, "d", "y", [0.001, 0.1], folds=3)
    return hog.detect(_large(spark, sf_dir, 40), "vec_id", "px", 40, weights, float(bias))


@query("detected_regions")
def detected_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows found in each image, overlapping ones grouped, and the group nearest to the image's middle."""
    boxes = kept(window_detector(spark, sf_dir).withColumn("id", F.monotonically_increasing_id()))
    all_images = images(spark, sf_dir).select("vec_id")
    stored = all_images.where(F.lit(False)).select("vec_id", F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    return detections.locate(all_images, stored, boxes, "vec_id", 40.0, 40.0)


@query(
    "ellipse_fit",
    f"""WITH {PX_SQL}, s AS (SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS r FROM px
        WINDOW w AS (PARTITION BY vec_id)),
    a AS (SELECT vec_id, count(*) AS n, sum(r) AS m, sum(r * x) / sum(r) AS cx, sum(r * y) / sum(r) AS cy, sum(r * x * x) / sum(r) AS xx,
      sum(r * y * y) / sum(r) AS yy, sum(r * x * y) / sum(r) AS xy FROM s WHERE r > 0.3 GROUP BY vec_id),
    c AS (SELECT *, xx - cx * cx AS p, yy - cy * cy AS q, xy - cx * cy AS o FROM a WHERE n >= 5),
    e AS (SELECT *, (p + q) / 2 AS t, sqrt(pow((p - q) / 2, 2) + o * o) AS d FROM c)
    SELECT vec_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(4 * sqrt(t + d), 6) AS width,
      round(4 * sqrt(greatest(t - d, 0)), 6) AS height, round(degrees(atan2(2 * o, p - q)) / 2, 6) AS angle FROM e""",
)
def ellipse_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ellipse with the second moments of an image's bright pixels, weighted by intensity."""
    scaled = images(spark, sf_dir).select("vec_id", px_ops.rescale_minmax(F.col("px")).alias("px"))
    bright = px_ops.explode_pixels(scaled, "vec_id", "px", 8).where(F.col("v") > 0.3)
    e = px_ops.moment_ellipse(bright, "vec_id")
    return e.select("vec_id", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "width", "height", "angle")])


@query("shape_regression")
def shape_regression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four landmarks around the intensity centroid, learnt and predicted with a small cascade."""
    scaled = images(spark, sf_dir).select("vec_id", px_ops.rescale_minmax(F.col("px")).alias("px"))
    m = px_ops.image_moments(px_ops.explode_pixels(scaled, "vec_id", "px", 8), "vec_id").select("vec_id", "cx", "cy")
    samples = cut_lineage(scaled.join(m, "vec_id").select(
        "vec_id", "px", F.lit(8).alias("width"),
        F.struct(*[F.lit(v).alias(c) for c, v in zip(shape_regression.BOX, (0.0, 0.0, 8.0, 8.0, 4.0, 4.0))]).alias("box"),
        F.array(*[
            F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
            for dx, dy in ((-2.0, 0.5), (0.0, -2.0), (2.0, 0.5), (0.0, 3.0))
        ]).alias("pts"),
    ))
    model = shape_regression.train(samples, "vec_id", cascades=1, ferns=2, candidates=30, pairs=3, starts=2, beta=10.0)
    out = shape_regression.predict(samples, "vec_id", model)
    return out.select("vec_id", shapes.polygon_area(F.col("pts")).alias("area"), "pts")


@query(
    "latest_by_rounded_point",
    """
    WITH k AS (SELECT *, round_even(l_quantity / 2, 0)::INTEGER AS kx, round_even(l_tax * 50, 0)::INTEGER AS ky FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, kx, ky ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM k)
    SELECT l_suppkey, kx, ky, l_orderkey, l_linenumber, l_partkey, l_shipdate FROM r WHERE rn = 1
    """,
)
def latest_by_rounded_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "lineitem").withColumns({
        "kx": F.bround(F.col("l_quantity") / 2).cast("int"), "ky": F.bround(F.col("l_tax") * 50).cast("int"),
    })
    cols = ["l_suppkey", "kx", "ky", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate"]
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(cols[:3])]
    order = [F.col("l_shipdate"), *[-F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey")]]
    newest = keyed.latest_per_key(k, keys, order, cols)
    # Sequences are delivered from the largest coordinate down, ties by their keys.
    return newest.orderBy(F.desc("kx"), "l_suppkey", "ky")
