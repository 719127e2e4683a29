"""Small solvers, ellipse fits and as-of joins against numpy and brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinestat.functions.linalg import least_norm_solution, solve_spd
from cinestat.operators import ellipses
from cinestat.operators.asof import asof_join


def test_positive_definite_systems(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        a = rng.standard_normal((n, n))
        m, b = a @ a.T, rng.standard_normal(n)
        got = spark.range(1).select(solve_spd([[F.lit(float(v)) for v in r] for r in m], [F.lit(float(v)) for v in b], 0.5).alias("x")).first()["x"]
        assert np.allclose(got, np.linalg.solve(m + 0.5 * np.eye(n), b))
    assert spark.range(1).select(solve_spd([[F.lit(0.0)]], [F.lit(1.0)]).alias("x")).first()["x"] == [None]


def test_least_norm_points_of_every_rank(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        rank = i % 4
        basis = rng.standard_normal((rank, 3)) if rank else np.zeros((1, 3))
        mix = rng.integers(-2, 3, (3, max(rank, 1))).astype(float)
        if rank and np.linalg.matrix_rank(mix) < rank:
            mix[:rank] = np.eye(rank)
        n = (mix @ basis) * 10.0 ** rng.integers(-6, 7)  # the rank does not depend on scale
        rows.append((i, *[float(v) for v in n.ravel()], *[float(v) for v in rng.standard_normal(3)]))
    names = [f"n{i}{j}" for i in range(3) for j in range(3)]
    df = spark.createDataFrame(rows, ["i", *names, "d0", "d1", "d2"])
    got = df.select("i", least_norm_solution([[F.col(f"n{i}{j}") for j in range(3)] for i in range(3)], [F.col(f"d{i}") for i in range(3)]).alias("p")).collect()
    for r in got:
        n, d = np.array(rows[r.i][1:10]).reshape(3, 3), np.array(rows[r.i][10:])
        assert r.p["rank"] == r.i % 4
        want = np.linalg.lstsq(n, d, rcond=1e-10)[0]
        assert np.allclose([r.p[c] for c in "xyz"], want, rtol=1e-6, atol=1e-9 * max(1.0, float(np.abs(want).max()))), (r, want)
    empty = spark.range(1).select(least_norm_solution([[F.lit(None).cast("double")] * 3] * 3, [F.lit(1.0)] * 3).alias("p")).first()["p"]
    assert empty["x"] is None


def numpy_ellipse(x, y, w):
    """The two stages with matrices of points."""
    mx, my, w = x.mean(), y.mean(), np.diag(w / w.max())
    x, y = x - mx, y - my
    a = np.stack([-x * x, -y * y, -x * y, x, y], 1)
    five = np.linalg.solve(a.T @ w @ a + np.eye(5), a.T @ w @ np.full(len(x), 10_000.0))
    c = np.array([[2 * five[0], five[2]], [five[2], 2 * five[1]]])
    r = np.linalg.solve(c.T @ c + np.eye(2), c.T @ five[3:])
    q = np.stack([(x - r[0]) ** 2, (y - r[1]) ** 2, (x - r[0]) * (y - r[1])], 1)
    return mx + r[0], my + r[1], np.linalg.solve(q.T @ w @ q + np.eye(3), q.T @ w @ np.ones(len(x)))


def test_ellipses(spark):
    rng, rows = np.random.default_rng(3), []
    for k in range(12):
        t = rng.uniform(0, 2 * np.pi, 60)
        turn = k / 7
        u, v = 30 * np.cos(t) + rng.normal(0, 0.2, 60), 12 * np.sin(t) + rng.normal(0, 0.2, 60)
        x, y = 1000 * k + u * np.cos(turn) - v * np.sin(turn), 50 + u * np.sin(turn) + v * np.cos(turn)
        rows += [(k, float(a), float(b), float(c)) for a, b, c in zip(x, y, rng.uniform(0.5, 2, 60))]
    rows += [(50, 1.0, 1.0, 1.0)] * 4 + [(51, None, 1.0, 1.0)] * 9 + [(None, *r[1:]) for r in rows[:60]]
    df = spark.createDataFrame(rows, "k int, x double, y double, w double")
    got = {r.k: r for r in ellipses.fit_ellipses(df.where("k is not null"), ["k"], "x", "y", "w").collect()}
    assert set(got) == set(range(12))
    for k, r in got.items():
        x, y, w = (np.array([v[i] for v in rows if v[0] == k]) for i in (1, 2, 3))
        cx, cy, (a, b, c) = numpy_ellipse(x, y, w)
        size = np.sort(2 / np.sqrt(np.linalg.eigvalsh([[a, c / 2], [c / 2, b]])))
        assert np.allclose([r.cx, r.cy, r.width, r.height], [cx, cy, *size], rtol=1e-7) and r.n == 60
        assert abs(r.width - 24) < 1.5 and abs(r.height - 60) < 3
    hot = {r.k: r for r in ellipses.fit_ellipses(df.where("k is not null"), ["k"], "x", "y", "w", hot_rows=7).collect()}
    assert all(np.allclose([hot[k][c] for c in ("cx", "cy", "width", "height", "angle")], [got[k][c] for c in ("cx", "cy", "width", "height", "angle")]) for k in got)
    at = ellipses.fit_ellipses_at(df.withColumns({"px": 1000.0 * F.col("k"), "py": F.lit(50.0)}), ["k"], "x", "y", "w", "px", "py", ridge=1e-6)
    assert all(abs(r.width - 24) < 1.5 and abs(r.height - 60) < 3 for r in at.collect() if r.k is not None and r.k < 12)


def brute_asof(left, right):
    out = Counter()
    for key, at, row in left:
        known = [(start, value) for k, start, value in right if k == key and start is not None and at is not None and start <= at]
        out[key, at, row, max(known, key=lambda x: (x[0], x[1] is not None, x[1] or 0))[1] if known else None] += 1
    return out


@pytest.mark.parametrize("per_range", [10**6, 40, 3])
def test_asof(spark, per_range):
    rng = random.Random(4)
    keys = ["a", "a", "a", "b", None]
    left = [(rng.choice(keys), rng.choice([None, *range(60)]), i % 7) for i in range(500)] + [("a", 30, 1)] * 300  # a crowded moment
    right = [(rng.choice([*keys, "c"]), rng.choice([None, *range(5, 60, 3)]), rng.choice([None, 1.5, 2.5, -1.0])) for _ in range(80)]
    ldf = spark.createDataFrame(left, "k string, at int, v int").withColumn("rate", F.lit("replaced"))
    rdf = spark.createDataFrame(right, "k string, since int, rate double")
    got = asof_join(ldf, rdf, "at", "since", ["rate"], ["k"], per_range)
    assert got.columns == ["k", "at", "v", "rate"]
    assert Counter((r.k, r.at, r.v, r.rate) for r in got.collect()) == brute_asof(left, right)
    one = asof_join(ldf.drop("rate"), rdf, "at", "since", ["rate"], per_range=per_range)
    assert Counter((None, r.at, r.v, r.rate) for r in one.collect()) == brute_asof([(None, *x[1:]) for x in left], [(None, *x[1:]) for x in right])
    none = spark.createDataFrame([], rdf.schema)
    assert asof_join(ldf, none, "at", "since", ["rate"], ["k"], per_range).where("rate is not null").count() == 0
    assert asof_join(spark.createDataFrame([], ldf.schema), rdf, "at", "since", ["rate"], ["k"], per_range).count() == 0
