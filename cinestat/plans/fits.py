"""Small systems solved per key, and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.functions.linalg import least_norm_solution
from cinestat.operators import ellipses
from cinestat.operators.asof import asof_join
from cinestat.plans.registry import query, table


@query(
    "dependent_planes",
    """WITH v AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn
      FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3),
    n AS (SELECT l_orderkey, (l_quantity % 3) - 1 AS nx, (l_partkey % 3)::DOUBLE - 1 AS ny, (l_suppkey % 2)::DOUBLE AS nz,
      l_quantity AS px, (l_suppkey % 7)::DOUBLE AS py, l_linenumber::DOUBLE AS pz FROM v WHERE rn = 1),
    m AS (SELECT *, nx * px + ny * py + nz * pz AS d FROM n),
    g AS (SELECT l_orderkey, sum(nx*nx) AS a, sum(ny*ny) AS b, sum(nz*nz) AS c, sum(nx*ny) AS f, sum(nx*nz) AS h, sum(ny*nz) AS e,
      sum(nx*d) AS u, sum(ny*d) AS v, sum(nz*d) AS w FROM m GROUP BY l_orderkey HAVING count(*) = 3),
    i AS (SELECT *, a + b + c AS c1, a*b - f*f + a*c - h*h + b*c - e*e AS c2, a*(b*c - e*e) - f*(f*c - e*h) + h*(f*e - b*h) AS c3 FROM g)
    SELECT l_orderkey, CASE WHEN c3 <> 0 THEN 3 WHEN c2 <> 0 THEN 2 WHEN c1 <> 0 THEN 1 ELSE 0 END AS rank,
      round(CASE WHEN c3 <> 0 THEN ((b*c - e*e) * u + (h*e - f*c) * v + (f*e - b*h) * w) / c3 WHEN c2 <> 0 THEN (c1*u - a*u - f*v - h*w) / c2
        WHEN c1 <> 0 THEN u / c1 ELSE 0 END, 6) + 0e0 AS x,
      round(CASE WHEN c3 <> 0 THEN ((h*e - f*c) * u + (a*c - h*h) * v + (f*h - a*e) * w) / c3 WHEN c2 <> 0 THEN (c1*v - f*u - b*v - e*w) / c2
        WHEN c1 <> 0 THEN v / c1 ELSE 0 END, 6) + 0e0 AS y,
      round(CASE WHEN c3 <> 0 THEN ((f*e - b*h) * u + (f*h - a*e) * v + (a*b - f*f) * w) / c3 WHEN c2 <> 0 THEN (c1*w - h*u - e*v - c*w) / c2
        WHEN c1 <> 0 THEN w / c1 ELSE 0 END, 6) + 0e0 AS z
    FROM i""",
)
def dependent_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes with normals of small whole numbers: every rank occurs, each with its shortest best point."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_linenumber").between(1, 3))
    line = F.col("l_linenumber")
    normal = [F.col("l_quantity") % 3 - 1, (F.col("l_partkey") % 3).cast("double") - 1, (F.col("l_suppkey") % 2).cast("double")]
    at = [F.col("l_quantity"), (F.col("l_suppkey") % 7).cast("double"), line.cast("double")]
    plane = F.struct(*[v.alias(c) for c, v in zip("xyz", normal)], (normal[0] * at[0] + normal[1] * at[1] + normal[2] * at[2]).alias("d"))
    order = F.struct("l_partkey", "l_suppkey", "l_quantity")
    views = li.groupBy("l_orderkey").agg(*[F.max_by(plane, F.when(line == k, order)).alias(f"v{k}") for k in (1, 2, 3)])
    views = views.where("v1 is not null and v2 is not null and v3 is not null")
    rows = [[F.col(f"v{k}")[c] for c in "xyz"] for k in (1, 2, 3)]
    point = views.select("l_orderkey", least_norm_solution(rows, [F.col(f"v{k}")["d"] for k in (1, 2, 3)]).alias("p"))
    return point.select("l_orderkey", "p.rank", *[(F.round(F.col("p")[c], 6) + 0.0).alias(c) for c in "xyz"])


def _eliminated(source: str, name: str, n: int, keep: str) -> str:
    """CTEs that solve ``a{i}{j} x = b{i}`` row by row: Gaussian elimination, then substitution from below."""
    out, last = [], source
    for k in range(n - 1):
        rows = range(k + 1, n)
        new = [f"a{i}{j} - a{i}{k} * a{k}{j} / a{k}{k} AS a{i}{j}" for i in rows for j in rows]
        new += [f"b{i} - a{i}{k} * b{k} / a{k}{k} AS b{i}" for i in rows]
        out.append(f"{name}{k} AS (SELECT * REPLACE ({', '.join(new)}) FROM {last})")
        last = f"{name}{k}"
    x = [f"(b{i}{''.join(f' - a{i}{j} * x{j}' for j in range(i + 1, n))}) / a{i}{i} AS x{i}" for i in reversed(range(n))]
    return ", ".join([*out, f"{name} AS MATERIALIZED (SELECT {keep}, {', '.join(x)} FROM {last})"])


def _normal_sql(terms: list[str], w: str, rhs: float, ridge: float) -> str:
    n = len(terms)
    cells = [f"sum({w} * ({terms[i]}) * ({terms[j]})) + {ridge if i == j else 0}::DOUBLE AS a{i}{j}" for i in range(n) for j in range(n)]
    return ", ".join([*cells, *[f"sum({w} * ({terms[i]}) * {rhs}) AS b{i}" for i in range(n)]])


_POINTS_SQL = """SELECT l_suppkey, l_quantity AS x, 0.3e0 * l_quantity + 2 * l_linenumber + 50 * l_discount AS y, 1 + 10 * l_tax AS w FROM lineitem"""
_AXES_SQL = """
    turned AS (SELECT *, -0.5e0 * atan2(x2, x1 - x0) AS turn FROM conic),
    sized AS (SELECT *, abs(x0 + x1 - t) AS far, abs(x0 + x1 + t) AS near FROM (
      SELECT *, CASE WHEN abs(x2) > 1e-8 THEN x2 / sin(-2e0 * turn) ELSE x1 - x0 END AS t FROM turned)),
    axes AS (SELECT *, 2 * CASE WHEN far > 1e-8 THEN sqrt(2e0 / far) ELSE far END AS u, 2 * CASE WHEN near > 1e-8 THEN sqrt(2e0 / near) ELSE near END AS v FROM sized)
    SELECT l_suppkey, n, round(cx, 4) AS cx, round(cy, 4) AS cy, round(least(u, v), 4) AS width, round(greatest(u, v), 4) AS height,
      round(CASE WHEN u > v THEN 90 + degrees(turn) ELSE 0 END, 3) AS angle FROM axes"""
_FIVE = ["-x*x", "-y*y", "-x*y", "x", "y"]
_THREE = ["(x - r0) * (x - r0)", "(y - r1) * (y - r1)", "(x - r0) * (y - r1)"]


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey", F.col("l_quantity").alias("x"), (0.3 * F.col("l_quantity") + 2 * F.col("l_linenumber") + 50 * F.col("l_discount")).alias("y"),
        (1 + 10 * F.col("l_tax")).alias("w"))


def _rounded(fit: DataFrame) -> DataFrame:
    return fit.select("l_suppkey", "n", *[F.round(c, 4).alias(c) for c in ("cx", "cy", "width", "height")], F.round("angle", 3).alias("angle"))


@query(
    "ellipse_two_stage",
    f"""WITH p AS (SELECT *, avg(x) OVER k AS mx, avg(y) OVER k AS my, max(w) OVER k AS mw FROM ({_POINTS_SQL}) WINDOW k AS (PARTITION BY l_suppkey)),
    c AS MATERIALIZED (SELECT l_suppkey, mx, my, x - mx AS x, y - my AS y, w / mw AS w FROM p),
    s1 AS (SELECT l_suppkey, any_value(mx) AS mx, any_value(my) AS my, count(*) AS n, {_normal_sql(_FIVE, 'w', 10000.0, 1.0)} FROM c GROUP BY l_suppkey HAVING count(*) >= 5),
    {_eliminated('s1', 'five', 5, 'l_suppkey, mx, my, n')},
    s2 AS (SELECT l_suppkey, mx, my, n, 4*x0*x0 + x2*x2 + 1 AS a00, 2*x2*(x0 + x1) AS a01, 2*x2*(x0 + x1) AS a10, x2*x2 + 4*x1*x1 + 1 AS a11,
      2*x0*x3 + x2*x4 AS b0, x2*x3 + 2*x1*x4 AS b1 FROM five),
    {_eliminated('s2', 'centre', 2, 'l_suppkey, mx, my, n')},
    s3 AS (SELECT l_suppkey, any_value(n) AS n, any_value(mx + r0) AS cx, any_value(my + r1) AS cy, {_normal_sql(_THREE, 'w', 1.0, 1.0)}
      FROM c JOIN (SELECT l_suppkey, n, x0 AS r0, x1 AS r1 FROM centre) USING (l_suppkey) GROUP BY l_suppkey),
    {_eliminated('s3', 'conic', 3, 'l_suppkey, n, cx, cy')}, {_AXES_SQL}""",
)
def ellipse_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ellipses.fit_ellipses(_points(spark, sf_dir), ["l_suppkey"], "x", "y", "w"))


@query(
    "ellipse_fixed_centre",
    f"""WITH c AS (SELECT *, 20e0 + l_suppkey % 10 AS r0, 20e0 AS r1 FROM ({_POINTS_SQL})),
    s3 AS (SELECT l_suppkey, count(*) AS n, any_value(r0) AS cx, any_value(r1) AS cy, {_normal_sql(_THREE, 'w', 1.0, 10000.0)} FROM c GROUP BY l_suppkey HAVING count(*) >= 5),
    {_eliminated('s3', 'conic', 3, 'l_suppkey, n, cx, cy')}, {_AXES_SQL}""",
)
def ellipse_fixed_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir).withColumns({"px": 20.0 + F.col("l_suppkey") % 10, "py": F.lit(20.0)})
    return _rounded(ellipses.fit_ellipses_at(points, ["l_suppkey"], "x", "y", "w", "px", "py"))


@query(
    "asof_rates",
    """WITH r AS (SELECT o_orderdate AS since, max(o_totalprice) AS rate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY o_orderdate)
    SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, r.rate FROM lineitem l ASOF LEFT JOIN r ON l.l_shipdate >= r.since""",
)
def asof_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate in force when each line shipped; the schedule is a table with several rows for some days."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'")
    rates = orders.select(F.col("o_orderdate").alias("since"), F.col("o_totalprice").alias("rate"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return asof_join(lines, rates, "l_shipdate", "since", ["rate"])


@query(
    "asof_last_error",
    """WITH e AS (SELECT user_id, ts AS error_at, max(value) AS error_value FROM events WHERE event_type = 'error' GROUP BY user_id, ts)
    SELECT a.event_id, a.user_id, a.ts, e.error_at, e.error_value FROM events a ASOF LEFT JOIN e ON a.user_id = e.user_id AND a.ts >= e.error_at""",
)
def asof_last_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with its user's last error so far."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error'").select("user_id", F.col("ts").alias("error_at"), F.col("value").alias("error_value"))
    return asof_join(events.select("event_id", "user_id", "ts"), errors.withColumn("since", F.col("error_at")), "ts", "since", ["error_at", "error_value"], ["user_id"])
