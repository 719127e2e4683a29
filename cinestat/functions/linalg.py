"""Small dense linear algebra in columns: solvers that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cinestat.functions.bind import let
from cinestat.functions.geometry import Vec, add, cross, dot, scale


def solve_spd(matrix: list[list[Column]], rhs: list[Column], ridge: float = 0.0) -> Column:
    """Array with the solution of ``(matrix + ridge I) x = rhs`` for a symmetric positive definite system.

    Gauss-Jordan steps over an array of rows; a positive definite matrix needs no pivoting.
    NULL in any entry, or a pivot of zero, gives NULL entries.
    """
    n = len(rhs)
    rows = F.array(*[
        F.array(*[(m + ridge if i == j else m).cast("double") for j, m in enumerate(row)], b.cast("double"))
        for i, (row, b) in enumerate(zip(matrix, rhs))])

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)
        unit = F.transform(pivot, lambda v: F.try_divide(v, F.get(pivot, k)))
        return let(unit, lambda u: F.transform(m, lambda row, i: F.when(i == k, u).otherwise(
            F.zip_with(row, u, lambda a, b: a - F.get(row, k) * b))))

    done = F.aggregate(F.array(*[F.lit(k) for k in range(n)]), rows, step)
    return F.transform(done, lambda row: F.get(row, n))


def least_norm_solution(rows: list[Vec], rhs: list[Column], tolerance: float = 1e-12) -> Column:
    """Struct ``rank, x, y, z``: the shortest vector that solves three equations in three unknowns best.

    That is the pseudo-inverse times ``rhs``.  The rank is judged free of scale: by the
    volume, and the areas, that the rows span beside the product of their lengths.

    * rank 3: Cramer's rule;
    * rank 2: normal equations, made regular by the direction that no row sees;
    * rank 1: along the row; rank 0: the origin.  NULL anywhere gives NULL in all fields.
    """
    size = [F.sqrt(dot(r, r)) for r in rows]
    pairs = [(0, 1), (1, 2), (2, 0)]
    fields = {f"n{i}{j}": v for i, r in enumerate(rows) for j, v in enumerate(r)}
    fields |= {f"d{i}": v for i, v in enumerate(rhs)} | {f"s{i}": v for i, v in enumerate(size)}
    bound = F.struct(*[v.cast("double").alias(k) for k, v in fields.items()])

    def with_rows(t: Column) -> Column:
        n = [[t[f"n{i}{j}"] for j in range(3)] for i in range(3)]
        c = [cross(n[i], n[j]) for i, j in pairs]
        more = F.struct(t.alias("t"), *[v.alias(f"c{i}{j}") for i, x in enumerate(c) for j, v in enumerate(x)])
        return let(more, with_crosses)

    def with_crosses(m: Column) -> Column:
        t = m["t"]
        n, d = [[t[f"n{i}{j}"] for j in range(3)] for i in range(3)], [t[f"d{i}"] for i in range(3)]
        s, c = [t[f"s{i}"] for i in range(3)], [[m[f"c{i}{j}"] for j in range(3)] for i in range(3)]
        volume = dot(n[0], c[1])
        areas = [F.sqrt(dot(x, x)) for x in c]
        flat = [a <= tolerance * s[i] * s[j] for a, (i, j) in zip(areas, pairs)]
        known = (volume + d[0] + d[1] + d[2]).isNotNull()
        rank = F.when(known, F.when(F.abs(volume) > tolerance * s[0] * s[1] * s[2], 3).when(
            ~(flat[0] & flat[1] & flat[2]), 2).when(F.greatest(*s) > 0, 1).otherwise(0))
        cramer = add(scale(c[1], d[0]), add(scale(c[2], d[1]), scale(c[0], d[2])))
        # Normal equations g x = b, with b = rows^T rhs.
        g = [[n[0][i] * n[0][j] + n[1][i] * n[1][j] + n[2][i] * n[2][j] for j in range(3)] for i in range(3)]
        b = [n[0][i] * d[0] + n[1][i] * d[1] + n[2][i] * d[2] for i in range(3)]
        trace = g[0][0] + g[1][1] + g[2][2]
        largest = F.greatest(*areas)
        unseen = [F.when(areas[0] == largest, c[0][i]).when(areas[1] == largest, c[1][i]).otherwise(c[2][i]) / largest for i in range(3)]
        two = solve_spd([[g[i][j] + trace * unseen[i] * unseen[j] for j in range(3)] for i in range(3)], b)
        out = F.when(rank == 3, F.array(*[x / volume for x in cramer])).when(rank == 2, two).when(
            rank == 1, F.array(*[x / trace for x in b])).when(rank == 0, F.array(*[F.lit(0.0)] * 3))
        return let(out, lambda x: F.struct(rank.alias("rank"), *[F.get(x, i).alias(a) for i, a in enumerate("xyz")]))

    return let(bound, with_rows)
