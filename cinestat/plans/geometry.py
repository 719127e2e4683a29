"""Geometry, shape and pixel queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cinestat.functions import cdf, geometry as g, shapes
from cinestat.functions.linalg import least_norm_solution
from cinestat.operators import pixels as px_ops
from cinestat.operators.keyed import attach_group
from cinestat.plans.registry import query, table


def _plane(s: str, n) -> g.Plane:
    """Image plane derived from the numeric columns of a line item held in struct ``s``."""
    c = F.col(s)
    return g.Plane(
        row=[F.lit(1.0), c["l_discount"], F.lit(0.1) * n],
        col=[c["l_tax"], F.lit(1.0), F.lit(-0.2) * n],
        pos=[c["l_quantity"], c["l_extendedprice"] / 1000, n],
        spacing=[1 + c["l_discount"], 1 + c["l_tax"]],
    )


def _packed(df: DataFrame, *structs: str) -> DataFrame:
    """Add a packed plane column for every struct of sequence columns."""
    planes = [_plane(c, F.col(c)["l_linenumber"].cast("double")).pack().alias(f"{c}_plane") for c in structs]
    return df.select("*", *planes)


def _round(v: Column, digits: int) -> Column:
    """Rounded to ``digits``; values of nearly dependent planes grow without bound and keep nine significant digits."""
    return F.when(F.abs(v) >= 1e9, F.format_string("%.8e", v).cast("double")).otherwise(F.round(v, digits))


def _round_sql(v: str, digits: int) -> str:
    return f"CASE WHEN abs({v}) >= 1e9 THEN printf('%.8e', {v})::DOUBLE ELSE round({v}, {digits}) END"


SEQ = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]

PLANES_SQL = """
    l AS (SELECT *, 1e0 AS rx, l_discount AS ry, 0.1e0 * l_linenumber AS rz, l_tax AS cx, 1e0 AS cy,
                 -0.2e0 * l_linenumber AS cz, l_quantity AS px, l_extendedprice / 1000 AS py,
                 l_linenumber::DOUBLE AS pz, 1 + l_discount AS sx, 1 + l_tax AS sy FROM lineitem),
    pl AS (SELECT *, ry * cz - rz * cy AS nx, rz * cx - rx * cz AS ny, rx * cy - ry * cx AS nz FROM l)
"""


@query(
    "plane_intersection",
    f"""WITH {PLANES_SQL},
    q AS (SELECT *, nx * px + ny * py + nz * pz AS d FROM pl),
    s AS (SELECT * FROM q WHERE l_linenumber % 3 = 0),
    v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3
            ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS rn FROM q WHERE l_linenumber % 3 > 0),
    a AS (SELECT * FROM v WHERE rn = 1 AND l_linenumber % 3 = 1),
    b AS (SELECT * FROM v WHERE rn = 1 AND l_linenumber % 3 = 2),
    j AS (SELECT s.l_orderkey, s.l_linenumber, s.l_partkey,
      a.l_orderkey IS NOT NULL AND b.l_orderkey IS NOT NULL AS views_ok,
      s.nx * (a.ny * b.nz - a.nz * b.ny) + s.ny * (a.nz * b.nx - a.nx * b.nz) + s.nz * (a.nx * b.ny - a.ny * b.nx) AS det,
      sqrt((s.nx*s.nx + s.ny*s.ny + s.nz*s.nz) * (a.nx*a.nx + a.ny*a.ny + a.nz*a.nz) * (b.nx*b.nx + b.ny*b.ny + b.nz*b.nz)) AS span,
      s.d * (a.ny * b.nz - a.nz * b.ny) + a.d * (b.ny * s.nz - b.nz * s.ny) + b.d * (s.ny * a.nz - s.nz * a.ny) AS tx,
      s.d * (a.nz * b.nx - a.nx * b.nz) + a.d * (b.nz * s.nx - b.nx * s.nz) + b.d * (s.nz * a.nx - s.nx * a.nz) AS ty,
      s.d * (a.nx * b.ny - a.ny * b.nx) + a.d * (b.nx * s.ny - b.ny * s.nx) + b.d * (s.nx * a.ny - s.ny * a.nx) AS tz,
      s.nx*s.d + a.nx*a.d + b.nx*b.d AS u, s.ny*s.d + a.ny*a.d + b.ny*b.d AS v, s.nz*s.d + a.nz*a.d + b.nz*b.d AS w,
      s.nx*s.nx + a.nx*a.nx + b.nx*b.nx AS g0, s.ny*s.ny + a.ny*a.ny + b.ny*b.ny AS g1, s.nz*s.nz + a.nz*a.nz + b.nz*b.nz AS g2,
      s.nx*s.ny + a.nx*a.ny + b.nx*b.ny AS f, s.nx*s.nz + a.nx*a.nz + b.nx*b.nz AS h, s.ny*s.nz + a.ny*a.nz + b.ny*b.nz AS e,
      s.px + 32 * s.sx * s.rx + 32 * s.sy * s.cx AS ox, s.py + 32 * s.sx * s.ry + 32 * s.sy * s.cy AS oy,
      s.pz + 32 * s.sx * s.rz + 32 * s.sy * s.cz AS oz
      FROM s LEFT JOIN a ON s.l_orderkey = a.l_orderkey LEFT JOIN b ON s.l_orderkey = b.l_orderkey),
    i AS (SELECT *, g0 + g1 + g2 AS c1, g0*g1 - f*f + g0*g2 - h*h + g1*g2 - e*e AS c2, abs(det) > 1e-12 * span AS whole FROM j)
    SELECT l_orderkey, l_linenumber, l_partkey, views_ok,
      CASE WHEN views_ok THEN {_round_sql('CASE WHEN whole THEN tx / det WHEN c2 > 1e-24 * c1 * c1 THEN (c1*u - g0*u - f*v - h*w) / c2 ELSE u / c1 END', 4)} ELSE round(ox, 5) END AS x,
      CASE WHEN views_ok THEN {_round_sql('CASE WHEN whole THEN ty / det WHEN c2 > 1e-24 * c1 * c1 THEN (c1*v - f*u - g1*v - e*w) / c2 ELSE v / c1 END', 4)} ELSE round(oy, 5) END AS y,
      CASE WHEN views_ok THEN {_round_sql('CASE WHEN whole THEN tz / det WHEN c2 > 1e-24 * c1 * c1 THEN (c1*w - h*u - e*v - g2*w) / c2 ELSE w / c1 END', 4)} ELSE round(oz, 5) END AS z
    FROM i""",
)
def plane_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where three views meet: the only common point, or of dependent planes the shortest best one."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*SEQ).alias("s"))
    kind = F.col("s.l_linenumber") % 3
    order = F.struct("s.l_linenumber", "s.l_partkey", "s.l_suppkey")

    def last(k: int):
        return F.max_by("s", F.when(kind == k, order))

    views = li.groupBy("l_orderkey").agg(
        last(1).alias("a"), last(2).alias("b"), F.count("*").alias("rows_in_key")
    )
    sax = attach_group(li.where(kind == 0), views, ["l_orderkey"], "rows_in_key")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull()
    sax = _packed(sax.withColumn("ok", ok), "s", "a", "b")
    planes = [g.Plane.unpack(F.col(f"{c}_plane")) for c in ("s", "a", "b")]
    meet = F.when(F.col("ok"), least_norm_solution([p.normal for p in planes], [g.dot(p.normal, p.pos) for p in planes]))
    centre = planes[0].to_space(F.lit(32.0), F.lit(32.0))
    found = sax.select("l_orderkey", "s", "ok", meet.alias("meet"), *[o.alias(f"o{c}") for c, o in zip("xyz", centre)])
    out = [F.when(F.col("ok"), _round(F.col("meet")[c], 4)).otherwise(F.round(f"o{c}", 5)).alias(c) for c in "xyz"]
    return found.select("l_orderkey", "s.l_linenumber", "s.l_partkey", F.col("ok").alias("views_ok"), *out)


@query(
    "plane_lines",
    f"""WITH {PLANES_SQL},
    o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS rn FROM pl),
    f AS MATERIALIZED (SELECT l_partkey, nx, ny, nz, nx * px + ny * py + nz * pz AS d FROM o WHERE rn = 1),
    e AS (SELECT o.l_orderkey, o.l_partkey, o.l_linenumber, o.l_suppkey, f.nx AS ax, f.ny AS ay, f.nz AS az, f.d AS d1,
          o.nx AS bx, o.ny AS by_, o.nz AS bz, o.nx * o.px + o.ny * o.py + o.nz * o.pz AS d2
          FROM o JOIN f USING (l_partkey)),
    m AS (SELECT *, ax*ax + ay*ay + az*az AS aa, bx*bx + by_*by_ + bz*bz AS bb, ax*bx + ay*by_ + az*bz AS ab FROM e),
    c AS MATERIALIZED (SELECT *, aa * bb - ab * ab AS det FROM m)
    SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
      {_round_sql('CASE WHEN det <> 0 THEN (d1*bb - d2*ab) / det * ax + (d2*aa - d1*ab) / det * bx END', 3)} AS px,
      {_round_sql('CASE WHEN det <> 0 THEN (d1*bb - d2*ab) / det * ay + (d2*aa - d1*ab) / det * by_ END', 3)} AS py,
      {_round_sql('CASE WHEN det <> 0 THEN (d1*bb - d2*ab) / det * az + (d2*aa - d1*ab) / det * bz END', 3)} AS pz,
      round(ay * bz - az * by_, 9) AS dx, round(az * bx - ax * bz, 9) AS dy, round(ax * by_ - ay * bx, 9) AS dz
    FROM c""",
)
def plane_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.struct(*SEQ).alias("s"))
    first = li.groupBy("l_partkey").agg(
        F.min_by("s", F.struct("l_orderkey", "s.l_linenumber", "s.l_suppkey", "s.l_quantity", "s.l_extendedprice", "s.l_discount", "s.l_tax")).alias("f"),
        F.count("*").alias("rows_in_key"),
    )
    both = attach_group(li, first, ["l_partkey"], "rows_in_key")
    both = _packed(both, "f", "s")
    a, b = (g.Plane.unpack(F.col(f"{c}_plane")) for c in ("f", "s"))
    point, along = g.plane_line(a, b)
    return both.select(
        "l_orderkey", "l_partkey", "s.l_linenumber", "s.l_suppkey",
        *[_round(v, 3).alias(f"p{c}") for c, v in zip("xyz", point)],
        *[F.round(v, 9).alias(f"d{c}") for c, v in zip("xyz", along)],
    )


@query(
    "point_roundtrip",
    f"""WITH {PLANES_SQL},
    p AS (SELECT *, px + l_quantity * sx * rx + l_linenumber * sy * cx AS x3,
                    py + l_quantity * sx * ry + l_linenumber * sy * cy AS y3,
                    pz + l_quantity * sx * rz + l_linenumber * sy * cz AS z3 FROM pl)
    SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, round(x3, 6) AS x3, round(y3, 6) AS y3, round(z3, 6) AS z3,
      l_quantity AS ix, l_linenumber::DOUBLE AS iy,
      round(abs(nx * (x3 + 1 - px) + ny * (y3 - py) + nz * (z3 - pz)), 6) AS dist,
      trunc(degrees(acos(nz / sqrt(nx*nx + ny*ny + nz*nz))))::INTEGER AS angle
    FROM p""",
)
def point_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(*SEQ).alias("s"))
    li = _packed(li, "s")
    p = g.Plane.unpack(F.col("s_plane"))
    there = p.to_space(F.col("s.l_quantity"), F.col("s.l_linenumber").cast("double"))
    out = li.select("*", *[v.alias(f"{c}3") for c, v in zip("xyz", there)])
    at = [F.col(f"{c}3") for c in "xyz"]
    back = p.to_image(at)
    moved = [at[0] + 1, at[1], at[2]]
    return out.select(
        "l_orderkey", "s.l_partkey", "s.l_linenumber", "s.l_suppkey",
        *[F.round(v, 6).alias(f"{c}3") for c, v in zip("xyz", at)],
        F.round(back[0], 6).alias("ix"), F.round(back[1], 6).alias("iy"),
        F.round(p.distance(moved), 6).alias("dist"),
        p.angle_to_z().cast("int").alias("angle"),
    )


@query(
    "axis_box",
    """
    WITH o AS (SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_linenumber * 10)::DOUBLE AS y0,
        max(l_linenumber * 10)::DOUBLE AS y1, avg(l_discount) AS d FROM lineitem GROUP BY l_orderkey),
    a AS (SELECT *, degrees(atan2(y1 - y0, x1 - x0)) AS ang FROM o),
    r AS (SELECT *, cos(radians(ang)) AS c, sin(radians(ang)) AS s FROM a),
    w AS (SELECT *, c * x0 + s * y0 + (1 - c) * 32 - s * 32 AS px, -s * x0 + c * y0 + s * 32 + (1 - c) * 32 AS ty,
                    -s * x1 + c * y1 + s * 32 + (1 - c) * 32 AS ly FROM r),
    h AS (SELECT *, abs(ty - ly) AS height, least(ty, ly) AS lo FROM w)
    SELECT l_orderkey, round(ang, 6) AS angle, round(px, 5) AS px, round(lo - least(0.2e0 * height, 20), 5) AS top,
      round(height + 2 * least(0.2e0 * height, 20), 5) AS box_height,
      round(greatest(least(px + 10, 40) - greatest(px - 10, 0), 0), 5) AS overlap FROM h
    """,
)
def axis_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = F.col("l_linenumber") * 10
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"),
        F.min(y).cast("double").alias("y0"), F.max(y).cast("double").alias("y1"),
    )
    o = o.withColumn("ang", F.degrees(F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0"))))
    m = g.rotation_about(F.col("ang"), F.lit(32.0), F.lit(32.0))
    a = g.affine(m, F.col("x0"), F.col("y0"))
    b = g.affine(m, F.col("x1"), F.col("y1"))
    w = o.select("l_orderkey", "ang", a[0].alias("px"), a[1].alias("ty"), b[1].alias("ly"))
    h = w.withColumn("height", F.abs(F.col("ty") - F.col("ly")))
    margin = F.least(F.lit(0.2) * F.col("height"), F.lit(20.0))
    own = [F.col("px") - 10, F.lit(0.0), F.lit(20.0), F.lit(1.0)]
    image = [F.lit(0.0), F.lit(0.0), F.lit(40.0), F.lit(1.0)]
    return h.select(
        "l_orderkey", F.round("ang", 6).alias("angle"), F.round("px", 5).alias("px"),
        F.round(F.least("ty", "ly") - margin, 5).alias("top"),
        F.round(F.col("height") + 2 * margin, 5).alias("box_height"),
        F.round(g.rect_intersection(own, image)[2], 5).alias("overlap"),
    )


PTS_SQL = """
    e AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    pts AS (SELECT vec_id, i, e[2 * i + 1] AS x, e[2 * i + 2] AS y FROM e, (SELECT unnest(range(32)) AS i))
"""


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding read as 32 planar landmarks."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", shapes.points(F.col("embedding")).alias("pts"))


@query(
    "polygon_area",
    f"""WITH {PTS_SQL},
    w AS (SELECT vec_id, x, coalesce(lead(y) OVER o, first_value(y) OVER f) AS yn, coalesce(lag(y) OVER o, last_value(y) OVER f) AS yp
      FROM pts WINDOW o AS (PARTITION BY vec_id ORDER BY i),
      f AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT vec_id, round(sum(x * (yn - yp)) / 2, 6) AS area FROM w GROUP BY vec_id""",
)
def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir)
    return s.select("vec_id", F.round(shapes.polygon_area(F.col("pts")), 6).alias("area"))


@query(
    "bounding_box",
    f"""WITH {PTS_SQL}
    SELECT vec_id, round(min(x), 6) AS start_x, round(min(y), 6) AS start_y, round(max(x) - min(x), 6) AS width,
           round(max(y) - min(y), 6) AS height FROM pts GROUP BY vec_id""",
)
def bounding_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _shapes(spark, sf_dir).select("vec_id", shapes.bounding_box(F.col("pts")).alias("b"))
    return b.select("vec_id", *[F.round(f"b.{c}", 6).alias(c) for c in ("start_x", "start_y", "width", "height")])


UNIT_SQL = f"""{PTS_SQL},
    b AS (SELECT vec_id, min(x) AS x0, max(x) - min(x) AS w, min(y) AS y0, max(y) - min(y) AS h FROM pts GROUP BY vec_id),
    u AS (SELECT vec_id, i, (x - (x0 + w / 2)) / (w / 2) AS x, (y - (y0 + h / 2)) / (h / 2) AS y FROM pts JOIN b USING (vec_id)),
    m AS (SELECT i, avg(x) AS x, avg(y) AS y FROM u GROUP BY i)
"""


def _unit_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _shapes(spark, sf_dir).withColumn("box", shapes.bounding_box(F.col("pts")))
    return s.withColumn("unit", shapes.project(F.col("pts"), F.col("box")))


def mean_shape(unit: DataFrame) -> DataFrame:
    """Mean position of every landmark: one row per landmark."""
    long = unit.select(F.posexplode("unit").alias("pos", "p"))
    return long.groupBy("pos").agg(F.avg("p.x").alias("x"), F.avg("p.y").alias("y"))


@query(
    "mean_shape",
    f"WITH {UNIT_SQL} SELECT i::INTEGER AS pos, round(x, 6) AS x, round(y, 6) AS y FROM m",
)
def mean_shape_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mean_shape(_unit_shapes(spark, sf_dir))
    return m.select("pos", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "similarity_transform",
    f"""WITH {UNIT_SQL},
    mc AS (SELECT i, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM m),
    uc AS (SELECT vec_id, i, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM u WINDOW w AS (PARTITION BY vec_id)),
    t AS (SELECT vec_id, sqrt(sum(pow(uc.x - uc.y, 2)) / 2) AS s1, sqrt(sum(pow(mc.x - mc.y, 2)) / 2) AS s2,
          sum(uc.y * mc.x - uc.x * mc.y) AS num, sum(uc.x * mc.x + uc.y * mc.y) AS den FROM uc JOIN mc USING (i) GROUP BY vec_id)
    SELECT vec_id, round(s1 / s2, 5) AS scale, round(den / sqrt(num*num + den*den), 5) AS cos_t,
           round(num / sqrt(num*num + den*den), 5) AS sin_t FROM t""",
)
def similarity_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = _unit_shapes(spark, sf_dir)
    entry = F.struct("pos", "x", "y")
    # One row with 32 entries: the size is that of a shape, not of the data.
    mean = mean_shape(unit).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["x"].alias("x"), e["y"].alias("y"))).alias("m")
    ).scalar()
    both = unit.select("vec_id", "unit", mean.alias("mean"))
    both = both.select("vec_id", shapes.centred(F.col("unit")).alias("u"), shapes.centred(F.col("mean")).alias("m"))
    t = both.select("vec_id", shapes.similarity(F.col("u"), F.col("m")).alias("t"))
    return t.select(
        "vec_id", F.round("t.scale", 5).alias("scale"), F.round("t.cos", 5).alias("cos_t"), F.round("t.sin", 5).alias("sin_t")
    )


CONTOUR_SQL = f"""{PTS_SQL},
    q AS (SELECT vec_id, i, trunc(x * 60)::INTEGER AS x, trunc(y * 60)::INTEGER AS y FROM pts),
    seg AS (SELECT vec_id, i, x AS x1, y AS y1, coalesce(lead(x) OVER o, first_value(x) OVER f) AS x2,
        coalesce(lead(y) OVER o, first_value(y) OVER f) AS y2 FROM q WINDOW o AS (PARTITION BY vec_id ORDER BY i),
        f AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    ax AS (SELECT *, abs(y2 - y1) > abs(x2 - x1) AS steep FROM seg),
    rot AS (SELECT *, CASE WHEN steep THEN y1 ELSE x1 END AS a1, CASE WHEN steep THEN x1 ELSE y1 END AS b1,
                      CASE WHEN steep THEN y2 ELSE x2 END AS a2, CASE WHEN steep THEN x2 ELSE y2 END AS b2 FROM ax),
    sw AS (SELECT vec_id, i, steep, a1 > a2 AS swapped, least(a1, a2) AS la, greatest(a1, a2) AS ha,
        CASE WHEN a1 > a2 THEN b2 ELSE b1 END AS lb, CASE WHEN a1 > a2 THEN b1 ELSE b2 END AS hb FROM rot),
    ras AS (SELECT vec_id, i, steep, swapped, la AS a, lb AS b, ha, ha - la AS da, abs(hb - lb) AS db,
        CASE WHEN lb < hb THEN 1 ELSE -1 END AS ys, (ha - la) // 2 AS err, 0 AS k FROM sw
      UNION ALL
      SELECT vec_id, i, steep, swapped, a + 1, CASE WHEN err - db < 0 THEN b + ys ELSE b END, ha, da, db, ys,
        CASE WHEN err - db < 0 THEN err - db + da ELSE err - db END, k + 1 FROM ras WHERE a < ha),
    dense AS (SELECT vec_id, i, CASE WHEN swapped THEN da - k ELSE k END AS k,
        CASE WHEN steep THEN b ELSE a END AS x, CASE WHEN steep THEN a ELSE b END AS y FROM ras)
"""


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    def grid(p):
        return F.struct((p["x"] * 60).cast("int").alias("x"), (p["y"] * 60).cast("int").alias("y"))

    q = _shapes(spark, sf_dir).select("vec_id", F.transform("pts", grid).alias("q"))
    return q.select("vec_id", shapes.dense_contour(F.col("q")).alias("contour"))


@query(
    "dense_contour",
    f"""WITH RECURSIVE {CONTOUR_SQL}
    SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY i, k) - 1)::INTEGER AS pos, x::INTEGER AS x, y::INTEGER AS y
    FROM dense""",
)
def dense_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir).select("vec_id", F.posexplode("contour").alias("pos", "p")).select(
        "vec_id", "pos", "p.x", "p.y"
    )


def _double_sql(src: str, dst: str) -> str:
    return f"""
    {dst} AS (SELECT vec_id, c, flatten(list_transform(range(len(m)), lambda j: [m[j + 1], list_position(c,
        list_select(CASE WHEN m[j + 1] < m[(j + 1) % len(m) + 1] THEN c[m[j + 1] + 1 : m[(j + 1) % len(m) + 1]]
             ELSE list_concat(c[m[j + 1] + 1 :], c[: m[(j + 1) % len(m) + 1]]) END,
          [len(CASE WHEN m[j + 1] < m[(j + 1) % len(m) + 1] THEN c[m[j + 1] + 1 : m[(j + 1) % len(m) + 1]]
             ELSE list_concat(c[m[j + 1] + 1 :], c[: m[(j + 1) % len(m) + 1]]) END) // 2 + 1])[1]) - 1])) AS m FROM {src})"""


@query(
    "contour_landmarks",
    f"""WITH RECURSIVE {CONTOUR_SQL},
    arr AS (SELECT vec_id, list({{'x': x, 'y': y}} ORDER BY i, k) AS c FROM dense GROUP BY vec_id),
    ext AS (SELECT vec_id, c, list_filter(c, lambda p: p.y = list_min(list_transform(c, lambda r: r.y))) AS t,
                   list_filter(c, lambda p: p.y = list_max(list_transform(c, lambda r: r.y))) AS b FROM arr),
    m2 AS (SELECT vec_id, c, [list_position(c, t[len(t) // 2 + 1]) - 1, list_position(c, b[len(b) // 2 + 1]) - 1] AS m FROM ext),
    {_double_sql('m2', 'm4')}, {_double_sql('m4', 'm8')}, {_double_sql('m8', 'm16')},
    o AS (SELECT vec_id, unnest(range(16)) AS pos, unnest(list_transform(m, lambda i: c[i + 1])) AS p FROM m16)
    SELECT vec_id, pos::INTEGER AS pos, p.x::INTEGER AS x, p.y::INTEGER AS y FROM o""",
)
def contour_landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _dense(spark, sf_dir).select("vec_id", shapes.contour_landmarks(F.col("contour")).alias("marks"))
    return d.select("vec_id", F.posexplode("marks").alias("pos", "p")).select("vec_id", "pos", "p.x", "p.y")


PX_SQL = """
    px AS (SELECT vec_id, label, (i // 8)::INTEGER AS y, (i % 8)::INTEGER AS x, embedding[i + 1]::DOUBLE AS v
           FROM embeddings, (SELECT unnest(range(64)) AS i))
"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding read as an 8x8 image."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("px"))


@query(
    "image_moments",
    f"""WITH {PX_SQL}, q AS (SELECT vec_id, x, y, abs(v) AS v FROM px)
    SELECT vec_id, round(sum(v), 6) AS m00, round(sum(x * v) / sum(v), 6) AS cx, round(sum(y * v) / sum(v), 6) AS cy
    FROM q GROUP BY vec_id""",
)
def image_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px_ops.explode_pixels(images(spark, sf_dir), "vec_id", "px", 8).withColumn("v", F.abs("v"))
    m = px_ops.image_moments(p, "vec_id")
    return m.select("vec_id", *[F.round(c, 6).alias(c) for c in ("m00", "cx", "cy")])


@query(
    "soft_region_mean",
    f"""WITH {PX_SQL}, h AS (SELECT vec_id, v, 0.5e0 * (1 + 2 / pi() * atan((3 - sqrt(pow(x - 3.5e0, 2) + pow(y - 3.5e0, 2))) / 1e0)) AS h FROM px)
    SELECT vec_id, round(sum(v * h) / sum(h), 6) AS inside, round(sum(v * (1 - h)) / sum(1 - h), 6) AS outside
    FROM h GROUP BY vec_id""",
)
def soft_region_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = px_ops.explode_pixels(images(spark, sf_dir), "vec_id", "px", 8)
    u = F.lit(3.0) - F.sqrt((F.col("x") - F.lit(3.5)) ** 2 + (F.col("y") - F.lit(3.5)) ** 2)
    m = px_ops.soft_mean(p, "vec_id", "v", cdf.regularized_heaviside(u))
    return m.select("vec_id", F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))


@query(
    "masked_radius",
    f"""WITH {PX_SQL}, s AS (SELECT *, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS r FROM px
        WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, round(avg(sqrt(pow(x - 4, 2) + pow(y - 4, 2))), 6) AS radius, count(*) AS n FROM s WHERE r > 0.5
    GROUP BY vec_id""",
)
def masked_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = images(spark, sf_dir).select("vec_id", px_ops.rescale_minmax(F.col("px")).alias("px"))
    p = px_ops.explode_pixels(scaled, "vec_id", "px", 8)
    r = px_ops.masked_radius(p, "vec_id", "v", F.lit(4.0), F.lit(4.0))
    return r.withColumn("radius", F.round("radius", 6))


@query(
    "intensity_scalings",
    f"""WITH {PX_SQL}, w AS (SELECT *, avg(v) OVER w AS m, stddev_pop(v) OVER w AS s, sqrt(sum(v * v) OVER w
        - 64 * avg(v) OVER w * avg(v) OVER w) AS nrm, max(v) OVER w AS hi, min(v) OVER w AS lo FROM px
        WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, y, x, round((v - m) / s, 5) AS z, round((v - m) / CASE WHEN nrm < 1e-8 THEN 1 ELSE nrm END, 5) AS gcn,
      round((v - lo) / (hi - lo), 6) AS unit, round(v / hi, 6) AS by_max, round((v * 255 - 128) / 128, 6) AS centred FROM w""",
)
def intensity_scalings(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("px")
    d = images(spark, sf_dir).select(
        "vec_id", "px", px_ops.standardize(px).alias("z"), px_ops.global_contrast(px).alias("gcn"),
        px_ops.rescale_minmax(px).alias("unit"), px_ops.rescale_max(px).alias("by_max"),
    )
    zipped = F.arrays_zip("px", "z", "gcn", "unit", "by_max")
    long = d.select("vec_id", F.posexplode(zipped).alias("i", "e"))
    return long.select(
        "vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"),
        F.round("e.z", 5).alias("z"), F.round("e.gcn", 5).alias("gcn"), F.round("e.unit", 6).alias("unit"),
        F.round("e.by_max", 6).alias("by_max"), F.round((F.col("e.px") * 255 - 128) / 128, 6).alias("centred"),
    )


@query(
    "crop_resize",
    f"""WITH {PX_SQL}, q AS (SELECT vec_id, y - 1 AS y, x - 1 AS x, v FROM px WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6),
    o AS (SELECT unnest(range(4)) AS o), ax AS (SELECT o, greatest((o + 0.5e0) * 1.5e0 - 0.5e0, 0) AS c FROM o),
    k AS (SELECT o, floor(c) AS c0, least(floor(c) + 1, 5) AS c1, c - floor(c) AS f FROM ax)
    SELECT vec_id, ky.o::INTEGER AS y, kx.o::INTEGER AS x, round(sum(v * (CASE WHEN q.y = ky.c0 THEN 1 - ky.f ELSE 0 END
       + CASE WHEN q.y = ky.c1 THEN ky.f ELSE 0 END) * (CASE WHEN q.x = kx.c0 THEN 1 - kx.f ELSE 0 END
       + CASE WHEN q.x = kx.c1 THEN kx.f ELSE 0 END)), 6) AS v
    FROM q, k ky, k kx GROUP BY vec_id, ky.o, kx.o""",
)
def crop_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = images(spark, sf_dir).select("vec_id", px_ops.crop(F.col("px"), 8, 1, 1, 6, 6).alias("px"))
    small = inner.select("vec_id", px_ops.resize_bilinear(F.col("px"), 6, 6, 4, 4).alias("px"))
    p = px_ops.explode_pixels(small, "vec_id", "px", 4)
    return p.withColumn("v", F.round("v", 6))


@query(
    "five_crop_mean",
    f"""WITH {PX_SQL}, o(ox, oy) AS (VALUES (0, 0), (2, 2), (0, 2), (2, 0), (1, 1)),
    c AS (SELECT vec_id, ox, oy, max(v) AS pred FROM px, o WHERE x >= ox AND x < ox + 6 AND y >= oy AND y < oy + 6 GROUP BY ALL)
    SELECT vec_id, round(avg(pred), 6) AS pred FROM c GROUP BY vec_id""",
)
def five_crop_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = images(spark, sf_dir).select("vec_id", px_ops.five_crops(F.col("px"), 8, 8, 6).alias("crops"))
    preds = F.transform("crops", lambda a: F.array_max(a))
    return c.select("vec_id", F.round(px_ops.array_mean(preds), 6).alias("pred"))


@query(
    "frame_stack_difference",
    f"""WITH {PX_SQL}, l AS (SELECT *, vec_id // 30 AS study, v - lag(v) OVER (PARTITION BY vec_id // 30, y, x ORDER BY vec_id) AS d FROM px)
    SELECT study, vec_id, y, x, round(d, 6) AS diff FROM l WHERE d IS NOT NULL""",
)
def frame_stack_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A study is a run of 30 frames; whole frames pass the window, not pixels.
    study = F.floor(F.col("vec_id") / 30)
    w = Window.partitionBy("study").orderBy("vec_id")
    frames = images(spark, sf_dir).select(study.alias("study"), "vec_id", "px")
    pairs = frames.withColumn("before", F.lag("px").over(w)).where(F.col("before").isNotNull())
    diff = pairs.select("study", "vec_id", F.posexplode(F.zip_with("px", "before", lambda a, b: a - b)).alias("i", "d"))
    return diff.select(
        "study", "vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"),
        F.round("d", 6).alias("diff"),
    )


@query(
    "plot_rescale",
    """
    WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events)
    SELECT event_id, greatest(trunc((value - lo) / (hi - lo) * 399), 0)::INTEGER AS pixel,
      round(0.114e0 * value + 0.587e0 * (value / 2) + 0.299e0 * (value / 4), 8) AS luma FROM events, m
    """,
)
def plot_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    m = ev.agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("m")).scalar()
    spot = (F.col("value") - m["lo"]) / (m["hi"] - m["lo"]) * 399
    return ev.select(
        "event_id", F.greatest(spot.cast("int"), F.lit(0)).alias("pixel"),
        F.round(cdf.luminance(F.col("value"), F.col("value") / 2, F.col("value") / 4), 8).alias("luma"),
    )
