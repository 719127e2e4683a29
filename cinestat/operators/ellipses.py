"""Weighted, ridge-regularised ellipse fits from sums per key."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, functions as F

from cinestat.functions.linalg import solve_spd
from cinestat.operators.keyed import HOT_ROWS, attach_group

# The right side of the first stage, and what counts as zero in a conic.
RIGHT, _EPS = 10_000.0, 1e-8
_ORDERS = [(i, j) for i in range(5) for j in range(5 - i)]


def _moments(x: Column, y: Column, w: Column) -> list[Column]:
    """Weighted sums of ``x^i y^j`` up to the fourth order."""
    px, py = [F.lit(1.0), x, x * x, x * x * x, x * x * x * x], [F.lit(1.0), y, y * y, y * y * y, y * y * y * y]
    return [F.sum(w * px[i] * py[j]).alias(f"m{i}{j}") for i, j in _ORDERS]


def _moved(i: int, j: int, dx: Column, dy: Column) -> Column:
    """The sum of ``(x - dx)^i (y - dy)^j`` from sums about the origin."""
    total = F.lit(0.0)
    for k in range(i + 1):
        for l in range(j + 1):
            term = F.col(f"m{k}{l}") * float(comb(i, k) * comb(j, l))
            for _ in range(i - k):
                term = term * -dx
            for _ in range(j - l):
                term = term * -dy
            total = total + term
    return total


def _conic(dx: Column, dy: Column, ridge: float) -> Column:
    """Coefficients of ``a x^2 + b y^2 + c x y = 1`` about a centre."""
    rows = [(2, 0), (0, 2), (1, 1)]
    matrix = [[_moved(a + c, b + d, dx, dy) for c, d in rows] for a, b in rows]
    return solve_spd(matrix, [_moved(a, b, dx, dy) for a, b in rows], ridge)


def _axes(df: DataFrame, keep: list[str]) -> DataFrame:
    """``width``, ``height`` (full axes) and ``angle`` (degrees) of conics ``abc``."""
    a, b, c = (F.get("abc", k) for k in range(3))
    turn = df.withColumn("turn", -0.5 * F.atan2(c, b - a))
    t = F.when(F.abs(c) > _EPS, F.try_divide(c, F.sin(-2.0 * F.col("turn")))).otherwise(b - a)
    far, near = F.abs(a + b - F.col("t")), F.abs(a + b + F.col("t"))

    def full(v: Column) -> Column:
        return 2 * F.when(v > _EPS, F.sqrt(2.0 / v)).otherwise(v)

    sized = turn.withColumn("t", t).select(*keep, "turn", full(far).alias("u"), full(near).alias("v"))
    return sized.select(
        *keep, F.least("u", "v").alias("width"), F.greatest("u", "v").alias("height"),
        F.when(F.col("u") > F.col("v"), 90 + F.degrees("turn")).otherwise(0.0).alias("angle"))


def fit_ellipses(
    points: DataFrame, keys: list[str], x: str, y: str, weight: str, ridge: float = 1.0, least: int = 5, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per key ``n``, ``cx``, ``cy``, ``width``, ``height``, ``angle`` of a conic fitted in two stages.

    First all five coefficients about the mean point (right side 10,000), which give the
    centre; then the three quadratic ones about that centre.  Weights are divided by the
    key's greatest; every system carries ``ridge`` on its diagonal.  Keys with fewer than
    ``least`` points have no row; points with a null count nowhere.

    Two aggregations with map-side sums: means, then moments about the mean, so that nothing
    cancels far from the origin.  Solving takes place on one row per key.
    """
    good = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull()).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"), F.col(weight).alias("w"))
    mean = good.groupBy(*keys).agg(
        F.avg("x").alias("mx"), F.avg("y").alias("my"), F.max("w").alias("mw"), F.count("*").alias("rows_in_key")).where(F.col("rows_in_key") >= least)
    near = attach_group(good, mean, keys, "rows_in_key", hot_rows)
    sums = near.groupBy(*keys).agg(
        F.first("mx").alias("mx"), F.first("my").alias("my"), F.count("*").alias("n"),
        *_moments(F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("w") / F.col("mw")))
    rows = [(2, 0, -1), (0, 2, -1), (1, 1, -1), (1, 0, 1), (0, 1, 1)]
    matrix = [[F.col(f"m{a + c}{b + d}") * (s * u) for c, d, u in rows] for a, b, s in rows]
    five = sums.withColumn("five", solve_spd(matrix, [F.col(f"m{a}{b}") * (RIGHT * s) for a, b, s in rows], ridge))
    a, b, c, d, e = (F.get("five", k) for k in range(5))
    # The centre's own system is not symmetric definite: its normal equations are, ridge included.
    centre = five.withColumn("centre", solve_spd(
        [[4 * a * a + c * c, 2 * c * (a + b)], [2 * c * (a + b), c * c + 4 * b * b]], [2 * a * d + c * e, c * d + 2 * b * e], ridge))
    at = centre.withColumns({"dx": F.get("centre", 0), "dy": F.get("centre", 1)})
    conic = at.withColumn("abc", _conic(F.col("dx"), F.col("dy"), ridge)).select(
        *keys, "n", (F.col("mx") + F.col("dx")).alias("cx"), (F.col("my") + F.col("dy")).alias("cy"), "abc")
    return _axes(conic, [*keys, "n", "cx", "cy"])


def fit_ellipses_at(
    points: DataFrame, keys: list[str], x: str, y: str, weight: str, cx: str, cy: str, ridge: float = 10_000.0, least: int = 5,
) -> DataFrame:
    """The same with a given centre per point row (columns ``cx``, ``cy``, alike in all rows of a key).

    One aggregation; weights are taken as they are.
    """
    names = (x, y, weight, cx, cy)
    good = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(weight).isNotNull()).select(
        *keys, *[F.col(c).alias(a) for c, a in zip(names, ("x", "y", "w", "px", "py"))])
    sums = good.groupBy(*keys).agg(
        F.first("px").alias("cx"), F.first("py").alias("cy"), F.count("*").alias("n"),
        *_moments(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("w"))).where(F.col("n") >= least)
    conic = sums.withColumn("abc", _conic(F.lit(0.0), F.lit(0.0), ridge))
    return _axes(conic, [*keys, "n", "cx", "cy"])
