"""Feature-table queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.operators import features as ft, histograms
from cinestat.operators.keyed import attach_group
from cinestat.plans.geometry import UNIT_SQL, _unit_shapes, images, mean_shape
from cinestat.plans.registry import query, table

BOUNDS_SQL = """
    b AS (SELECT p_brand, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 100 AS v
          FROM lineitem JOIN part ON p_partkey = l_partkey),
    sp AS (SELECT p_brand, min(v) AS vmin, max(v) AS vmax FROM b GROUP BY p_brand),
    h AS (SELECT p_brand, floor((v - vmin) * 100 / (vmax - vmin))::INTEGER AS slot, count(*) AS n FROM b JOIN sp USING (p_brand)
          WHERE v < vmax GROUP BY ALL),
    g AS (SELECT p_brand, s AS slot, coalesce(sum(h.n) FILTER (h.slot <= s), 0) / sum(h.n) AS share
          FROM h, (SELECT unnest(range(100)) AS s) GROUP BY p_brand, s),
    e AS (SELECT p_brand, coalesce(min(slot) FILTER (share > 0.05), 99) AS lo,
            coalesce(max(slot) FILTER (share <= 0.95), 0) AS hi0 FROM g GROUP BY p_brand),
    q AS (SELECT p_brand, vmin, vmax, trunc(vmin * (least(lo, 99) / 100))::BIGINT AS lo,
            trunc(vmax * ((CASE WHEN hi0 < 98 THEN hi0 + 1 ELSE hi0 END) / 100))::BIGINT AS hi FROM e JOIN sp USING (p_brand))
"""


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    # `part` and `lineitem` both grow with the data: the join is left to the planner.
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.join(part, "l_partkey").withColumn("v", F.col("l_extendedprice") / 100)


@query("quantile_bounds", f"WITH {BOUNDS_SQL} SELECT p_brand, lo, hi FROM q")
def quantile_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = histograms.quantile_bounds(_priced(spark, sf_dir), ["p_brand"], "v", 0.05, 0.95)
    return b.select("p_brand", "lo", "hi")


@query(
    "intensity_stretch",
    f"""WITH {BOUNDS_SQL}
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(greatest((v - lo) / (hi - lo), 0), 1), 6) AS stretched,
           round(least((v - lo) / (hi - lo), 1), 6) AS upper_only FROM b JOIN q USING (p_brand)""",
)
def intensity_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _priced(spark, sf_dir)
    bounds = histograms.quantile_bounds(rows, ["p_brand"], "v", 0.05, 0.95).select("p_brand", "lo", "hi", "rows_in_key")
    both = attach_group(rows, bounds, ["p_brand"], "rows_in_key")
    unit = F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))
    return both.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.when(unit < 0, 0.0).when(unit > 1, 1.0).otherwise(unit), 6).alias("stretched"),
        F.round(F.when(unit > 1, 1.0).otherwise(unit), 6).alias("upper_only"),
    )


@query(
    "exact_percentiles",
    """SELECT round(quantile_cont(l_extendedprice, 0.01), 6) AS q0, round(quantile_cont(l_extendedprice, 0.5), 6) AS q1,
       round(quantile_cont(l_extendedprice, 0.99), 6) AS q2 FROM lineitem""",
)
def exact_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = histograms.exact_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", [0.01, 0.5, 0.99])
    return q.select(*[F.round(c, 6).alias(c) for c in ("q0", "q1", "q2")])


@query(
    "percentile_clamp",
    """
    WITH f AS (SELECT l_orderkey AS k, min(l_extendedprice) / 200 AS v_min, max(l_extendedprice) / 200 AS v_max,
        min(l_quantity) * 5 AS v_min_cpr, max(l_quantity) * 12 AS v_max_cpr FROM lineitem GROUP BY l_orderkey),
    y AS (SELECT o_orderkey AS k, o_totalprice / 1500 AS s, o_totalprice / 1000 AS d FROM orders),
    p AS (SELECT quantile_cont(s, 0.01) AS s1, quantile_cont(s, 0.99) AS s9, quantile_cont(d, 0.01) AS d1, quantile_cont(d, 0.99) AS d9 FROM y),
    c AS (SELECT k, least(greatest(v_min, s1), s9) AS v_min, least(greatest(v_min_cpr, s1), s9) AS v_min_cpr,
        least(greatest(v_max, d1), d9) AS v_max, least(greatest(v_max_cpr, d1), d9) AS v_max_cpr FROM f, p)
    SELECT k AS l_orderkey, ph::INTEGER AS is_diastole, round(v_min, 8) AS v_min, round(v_max, 8) AS v_max,
        round((v_min_cpr + v_min) / 2, 8) AS mean_sys, round((v_max + v_max_cpr) / 2, 8) AS mean_dias,
        round(CASE ph WHEN 0 THEN s ELSE d END, 8) AS label FROM c JOIN y USING (k), (VALUES (0), (1)) t(ph)
    """,
)
def percentile_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phase_table(spark, sf_dir)
    return rows.select(
        "l_orderkey", "is_diastole", *[F.round(c, 8).alias(c) for c in ("v_min", "v_max", "mean_sys", "mean_dias", "label")]
    )


def phase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two labelled rows per order, from order-level features."""
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        (F.min("l_extendedprice") / 200).alias("v_min"), (F.max("l_extendedprice") / 200).alias("v_max"),
        (F.min("l_quantity") * 5).alias("v_min_cpr"), (F.max("l_quantity") * 12).alias("v_max_cpr"),
    )
    y = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") / 1500).alias("systole"),
        (F.col("o_totalprice") / 1000).alias("diastole"),
    )
    return ft.phase_rows(f, y, "l_orderkey")


FERN_SQL = """CASE WHEN l_quantity - l_linenumber * 6 >= 1.5e0 THEN 1 ELSE 0 END + CASE WHEN l_discount * 100 - l_quantity >= -20e0 THEN 2 ELSE 0 END
    + CASE WHEN l_tax * 100 - l_discount * 100 >= 0.5e0 THEN 4 ELSE 0 END"""


@query(
    "fern_bin_means",
    f"""WITH b AS (SELECT {FERN_SQL} AS bin, l_tax, l_extendedprice FROM lineitem)
    SELECT bin, count(*) AS n, round(sum(l_tax) / ((1 + 1000e0 / count(*)) * count(*)), 6) AS l_tax,
      round(sum(l_extendedprice) / ((1 + 1000e0 / count(*)) * count(*)), 4) AS l_extendedprice FROM b GROUP BY bin""",
)
def fern_bin_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    pairs = [
        (c("l_quantity"), c("l_linenumber") * 6), (c("l_discount") * 100, c("l_quantity")),
        (c("l_tax") * 100, c("l_discount") * 100),
    ]
    b = ft.fern_bins(table(spark, sf_dir, "lineitem"), ft.fern_index(pairs, [1.5, -20.0, 0.5]), ["l_tax", "l_extendedprice"])
    return b.select("bin", "n", F.round("l_tax", 6).alias("l_tax"), F.round("l_extendedprice", 4).alias("l_extendedprice"))


COV_SQL = """
    e AS (SELECT vec_id, label, i, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
    cv AS (SELECT a.i, b.i AS j, covar_pop(a.v, b.v) AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY ALL)
"""


@query("pixel_covariance", f"WITH {COV_SQL} SELECT i::INTEGER AS i, j::INTEGER AS j, round(cov, 8) AS cov FROM cv")
def pixel_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = ft.covariance_long(images(spark, sf_dir), "px")
    return c.withColumn("cov", F.round("cov", 8))


@query(
    "fern_pair_scores",
    f"""WITH {COV_SQL}, t AS (SELECT i, covar_pop(label, v) AS tc FROM e GROUP BY i)
    SELECT cv.i::INTEGER AS i, cv.j::INTEGER AS j, round(abs(x.tc - y.tc) / sqrt(a.cov + b.cov - 2 * cv.cov), 6) AS score
    FROM cv JOIN cv a ON a.i = cv.i AND a.j = cv.i JOIN cv b ON b.i = cv.j AND b.j = cv.j
    JOIN t x ON x.i = cv.i JOIN t y ON y.i = cv.j WHERE cv.i < cv.j""",
)
def fern_pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    img = images(spark, sf_dir)
    scores = ft.strongest_pairs(ft.covariance_long(img, "px"), ft.target_covariance(img, "px", F.col("label")))
    return scores.withColumn("score", F.round("score", 6))


@query(
    "nearest_landmark",
    f"""WITH {UNIT_SQL}, c AS (SELECT p_partkey, (p_size - 25) / 25e0 AS x, (p_retailprice % 400) / 200 - 1 AS y FROM part),
    d AS (SELECT p_partkey, i, c.x - m.x AS dx, c.y - m.y AS dy, pow(m.x - c.x, 2) + pow(m.y - c.y, 2) AS d FROM c, m)
    SELECT p_partkey, i::INTEGER AS landmark, round(dx, 6) AS dx, round(dy, 6) AS dy FROM (
      SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, i) AS rn FROM d) WHERE rn = 1""",
)
def nearest_landmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mean_shape(_unit_shapes(spark, sf_dir))
    entry = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    pts = m.agg(F.transform(entry, lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"))).alias("m")).scalar()
    c = table(spark, sf_dir, "part").select(
        "p_partkey", ((F.col("p_size") - 25) / 25.0).alias("x"), (F.col("p_retailprice") % 400 / 200 - 1).alias("y"), pts.alias("m")
    )
    hit = c.select("p_partkey", "x", "y", "m", ft.nearest_point(F.col("m"), F.col("x"), F.col("y"))["i"].alias("landmark"))
    at = F.get("m", F.col("landmark"))
    return hit.select(
        "p_partkey", "landmark", F.round(F.col("x") - at["x"], 6).alias("dx"), F.round(F.col("y") - at["y"], 6).alias("dy")
    )


@query(
    "nearest_detection",
    """
    WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 4 AS x, l_tax * 2000 AS y, 32e0 + l_linenumber AS w, 32e0 AS h FROM lineitem),
    d AS (SELECT *, sqrt(pow(x + w / 2 - 128, 2) + pow(y + h / 2 - 128, 2)) AS d FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY d, l_linenumber, l_partkey, l_suppkey) AS rn FROM d)
    SELECT l_orderkey, d < 64 AS detected, CASE WHEN d < 64 THEN x ELSE 118 END AS x, CASE WHEN d < 64 THEN y ELSE 118 END AS y,
      CASE WHEN d < 64 THEN w ELSE 20 END AS w, CASE WHEN d < 64 THEN h ELSE 20 END AS h FROM r WHERE rn = 1
    """,
)
def nearest_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 4).alias("x"),
        (F.col("l_tax") * 2000).alias("y"), (F.lit(32.0) + F.col("l_linenumber")).alias("w"), F.lit(32.0).alias("h"),
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey")]
    return ft.nearest_box(b, "l_orderkey", F.lit(128.0), F.lit(128.0), order, 256.0)


@query(
    "negative_boxes",
    """
    WITH p AS (SELECT c_custkey, (c_custkey % 180)::INTEGER AS x, (c_custkey * 7 % 180)::INTEGER AS y, 48 AS w, 40 AS h FROM customer),
    d AS (SELECT *, md5('42:' || c_custkey || ':' || draw) AS m FROM p, (SELECT unnest(range(4096))::INTEGER AS draw)),
    s AS (SELECT *, (('0x' || substr(m, 1, 8))::BIGINT % 64 + 24)::INTEGER AS size FROM d),
    n AS (SELECT *, (('0x' || substr(m, 9, 8))::BIGINT % (256 - size))::INTEGER AS nx, (('0x' || substr(m, 17, 8))::BIGINT % (256 - size))::INTEGER AS ny FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY draw) AS rn FROM n
      WHERE greatest(least(nx + size, x + w) - greatest(nx, x), 0) * greatest(least(ny + size, y + h) - greatest(ny, y), 0) <= 0.2e0 * w * h)
    SELECT c_custkey, draw, nx, ny, size FROM k WHERE rn <= 5
    """,
)
def negative_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_custkey") % 180).cast("int").alias("x"), (F.col("c_custkey") * 7 % 180).cast("int").alias("y"),
        F.lit(48).alias("w"), F.lit(40).alias("h"),
    )
    return ft.negative_boxes(p, ["c_custkey"], 256, 256)
