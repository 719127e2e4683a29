"""Boosting, grouped detections and warps against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinestat.functions import geometry as g
from cinestat.models.boosting import Boosted, Tree, huber_boosting
from cinestat.operators import augment, detections, label_graph, pixels, ring


def grown(x, y, trees, depth, rate, quantile, bins):
    """The same trees row by row."""
    at = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    now = np.full(len(y), at(y, 0.5))
    bounds = [sorted({at(c, k / bins) for k in range(1, bins)}) for c in x.T]
    for _ in range(trees):
        r = y - now
        edge = at(np.abs(r), quantile)
        grad, node = np.clip(r, -edge, edge), np.ones(len(y), int)
        for level in range(depth):
            for n in [k for k in set(node.tolist()) if k.bit_length() == level + 1]:
                mine, best = node == n, (1e-9, None)
                for f, cuts in enumerate(bounds):
                    for b in cuts:
                        low, high = grad[mine & (x[:, f] <= b)], grad[mine & (x[:, f] > b)]
                        if len(low) and len(high):
                            gain = low.sum() ** 2 / len(low) + high.sum() ** 2 / len(high) - grad[mine].sum() ** 2 / mine.sum()
                            if gain > best[0] * (1 + 1e-9):
                                best = gain, (f, b)
                if best[1]:
                    node[mine] = 2 * n + (x[mine, best[1][0]] > best[1][1])
        for n in set(node.tolist()):
            m = at(r[node == n], 0.5)
            now[node == n] += rate * (m + np.clip(r[node == n] - m, -edge, edge).mean())
    return now


def test_huber_boosting(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.uniform(0, 10, (400, 3)), 2)
    y = np.round(3 * x[:, 0] + np.where(x[:, 1] > 5, 20, 0) + rng.standard_t(1.5, 400), 3)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = huber_boosting(df, ["a", "b", "c"], "y", trees=4, depth=3, rate=0.3, bins=10, cut_every=2)
    got = np.array([r["prediction"] for r in model.predict(df).collect()])
    assert np.allclose(got, grown(x, y, 4, 3, 0.3, 0.9, 10))
    assert [f for f, _ in model.importance()][-1] == "c" and model.importance()[0][1] == 100
    odd = df.limit(50).unionByName(spark.createDataFrame([(None, 1.0, None, 2.0), (None, None, None, None)], df.schema))
    assert huber_boosting(odd, ["a", "b", "c"], "y", trees=1, depth=2).predict(odd).where("prediction is null").count() == 0
    flat = huber_boosting(df.withColumn("y", F.lit(3.0)), ["a"], "y", trees=2, depth=2)
    assert flat.predict(df).select("prediction").distinct().collect()[0][0] == 3.0
    assert huber_boosting(df.where("false"), ["a"], "y", trees=2).trees == []
    assert Boosted(["a"], 1.0, 0.1, [Tree()], [0.0]).importance() == [("a", 0.0)]


def grouped(boxes, least=3, eps=0.2):
    """Classes of one image by comparing all pairs."""
    root = list(range(len(boxes)))
    for i, (x, y, w, h) in enumerate(boxes):
        for j, (u, v, a, b) in enumerate(boxes[:i]):
            most = eps / 2 * (min(w, a) + min(h, b))
            if max(abs(x - u), abs(y - v), abs(x + w - u - a), abs(y + h - v - b)) <= most:
                root = [root[j] if k == root[i] else k for k in root]
    held = defaultdict(list)
    for box, r in zip(boxes, root):
        held[r].append(box)
    means = [(len(v), *np.mean(v, axis=0)) for v in held.values() if len(v) >= least]

    def within(p, q):
        dx, dy = eps * q[3], eps * q[4]
        return p[1] >= q[1] - dx and p[2] >= q[2] - dy and p[1] + p[3] <= q[1] + q[3] + dx and p[2] + p[4] <= q[2] + q[4] + dy and (q[0] > max(3, p[0]) or p[0] < 3)

    return [p for i, p in enumerate(means) if not any(within(p, q) for j, q in enumerate(means) if i != j)]


def test_detections_are_grouped(spark):
    rng = random.Random(2)
    rows, images = [], {}
    for image in range(30):
        boxes = []
        for _ in range(rng.randrange(5)):
            x, y, s = rng.uniform(-20, 200), rng.uniform(0, 200), rng.uniform(8, 90)
            boxes += [(x + rng.gauss(0, s / 25), y + rng.gauss(0, s / 25), s * rng.uniform(0.95, 1.05), s * rng.uniform(0.95, 1.05)) for _ in range(rng.randrange(1, 8))]
        boxes += [(50.0, 50.0, 30.0, 30.0)] * rng.randrange(5) + [(52.0, 52.0, 20.0, 20.0)] * 3
        boxes += [(100.0 + 3 * i, 10.0, 40.0, 40.0) for i in range(rng.randrange(12))]  # a chain
        images[image] = boxes
        rows += [(image, *b) for b in boxes]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)] + [(10**6, 1, None, 1.0, 1.0, 1.0), (10**6 + 1, 1, 1.0, 1.0, 0.0, 0.0)],
                               "id long, image int, x double, y double, w double, h double")
    got = defaultdict(list)
    for r in detections.group_boxes(df, "image").collect():
        got[r.image].append((r.n, r.x, r.y, r.w, r.h))
    for image, boxes in images.items():
        assert np.allclose(sorted(got[image]), sorted(grouped(boxes))), image
    assert detections.group_boxes(df.where("false"), "image").count() == 0
    stored = spark.createDataFrame([(0, 5.0, 5.0), (1, 400.0, 5.0), (2, None, None)], "image int, cx double, cy double")
    where = {r.image: r for r in detections.locate(df.select("image").distinct(), stored, df, "image", 256.0, 256.0).collect()}
    assert len(where) == 30 and where[0].origin == "stored" and where[1].origin != "stored" and (where[0].cx, where[0].cy) == (5.0, 5.0)
    assert all(0 <= abs(r.cx - 128) <= 64 for r in where.values() if r.origin == "detected")


@pytest.mark.parametrize("shape", [(8, 8), (5, 9)])
def test_warps(spark, shape):
    rng, (h, w) = np.random.default_rng(3), shape
    rows = []
    for k in range(30):
        m = rng.normal(0, 1, (2, 3)) * [[1, 1, 4], [1, 1, 4]] if k % 3 else np.array([[1.0, 0, k / 3 - 3], [0, 1.0, 0]])
        rows.append((k, rng.random(h * w).tolist(), *map(float, m.ravel())))
    names = [f"m{i}" for i in range(6)]
    df = spark.createDataFrame([*rows, (99, None, *[1.0] * 6), (98, rows[0][1], None, *[1.0] * 5)], "k int, px array<double>, " + ", ".join(f"{n} double" for n in names))
    out = df.select("k", pixels.warp_affine(F.col("px"), w, h, [[F.col(n) for n in names[:3]], [F.col(n) for n in names[3:]]], 7, 6).alias("px"))
    got = {r.k: r.px for r in out.collect()}
    assert got[98] is None and got[99] is None
    for k, px, *m in rows:
        want = augment.warp(np.array(px).reshape(h, w), np.array([*m, 0, 0, 1]).reshape(3, 3), (6, 7))
        assert np.allclose(got[k], want.ravel()), k
    turned = df.where("k < 9").select("k", "px", pixels.warp_affine(F.col("px"), w, h, g.rotation_about(F.lit(0.0), F.lit(1.0), F.lit(1.0)), w, h).alias("same"))
    assert all(np.allclose(r.px, r.same) for r in turned.collect())


def test_grid_is_smoothed_both_ways(spark):
    rng = np.random.default_rng(4)
    a = rng.random((5, 7))
    rows = [("k", i, j, float(v)) for (i, j), v in np.ndenumerate(a)] + [("one", 1, j, float(j)) for j in range(4)] + [("dot", 1, 1, 2.5)]
    got = {(r.k, r.i, r.j): r.smooth for r in ring.smoothed_grid(spark.createDataFrame(rows, "k string, i int, j int, v double"), ["k"], "i", "j", "v").collect()}
    c = 0.25 * np.roll(a, 1, 1) + 0.5 * a + 0.25 * np.roll(a, -1, 1)
    p = np.concatenate([c[1:2], c, c[-2:-1]])
    want = 0.25 * p[:-2] + 0.5 * p[1:-1] + 0.25 * p[2:]
    assert all(np.isclose(got["k", i, j], v) for (i, j), v in np.ndenumerate(want))
    assert np.isclose(got["one", 1, 0], 0.25 * 3 + 0.25 * 1) and got["dot", 1, 1] == 2.5


@pytest.mark.parametrize("solver", ["belief", "modes"])
def test_labelling_ends_when_the_energy_rests(spark, solver):
    labels, smooth = [1, 2, 0], label_graph.potts([1, 2, 0], 7.0, unknown=0)
    rng = random.Random(5)
    rows = [(k, s, [float(rng.randrange(40)) for _ in labels]) for k in range(6) for s in range(16)] + [(9, s, [0.0, 50.0, 60.0]) for s in range(16)]
    sites = spark.createDataFrame(rows, "g int, site int, costs array<double>")
    edges = label_graph.grid_edges(sites, "g", 4, 4)

    def after(r):
        if r == 0:
            return label_graph.initial_labels(sites, "g", labels)
        run = label_graph.belief_propagation if solver == "belief" else label_graph.iterated_modes
        return run(sites, edges, "g", labels, smooth, r)

    def energies(r):
        return {x["g"]: x["energy"] for x in label_graph.energy(after(r), edges, "g", labels, smooth).collect()}

    got = label_graph.settle_labels(sites, edges, "g", labels, smooth, solver=solver)
    found = got.collect()
    ends = {r["g"]: (r["rounds"], r["converged"]) for r in found}
    assert len(found) == 7 * 16 and ends[9] == (1, True)
    most = max(r for r, _ in ends.values())
    e = [energies(r) for r in range(most + 1)]
    for g, (r, converged) in ends.items():
        want = next(k for k in range(1, most + 1) if e[k][g] == e[k - 1][g] or k > 1 and e[k][g] >= e[k - 1][g])
        assert r == want and converged == (e[r][g] == e[r - 1][g])
    for r in set(x for x, _ in ends.values()):
        held = {(x["g"], x["site"]): x["label"] for x in after(r).collect()}
        assert all(held[x["g"], x["site"]] == x["label"] for x in found if x["rounds"] == r)
    cut = label_graph.settle_labels(sites, edges, "g", labels, smooth, solver=solver, most_rounds=1).collect()
    assert len(cut) == 7 * 16 and {x["rounds"] for x in cut} == {1}
    with pytest.raises(ValueError, match="unknown solver"):
        label_graph.settle_labels(sites, edges, "g", labels, smooth, solver="cuts")


def test_boxes_of_small_and_busy_keys_meet_alike(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), rng.uniform(0, 40), rng.uniform(0, 40), rng.uniform(5, 30), rng.uniform(5, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, image int, x double, y double, w double, h double")
    whole, grid, both = (sorted(map(tuple, detections.similar_pairs(df, "image", few=k).collect())) for k in (10**6, 0, 100))
    assert whole == grid == both and whole
    plan = detections.similar_pairs(df, "image", few=10**6)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan  # a box is not sent to cells


def test_detections_gather_no_table_at_the_driver(spark):
    df = spark.createDataFrame([(i, i // 9, 5.0 + i % 3, 5.0, 20.0, 20.0) for i in range(90)], "id long, image int, x double, y double, w double, h double")
    stored = spark.createDataFrame([(0, 5.0, 5.0)], "image int, cx double, cy double")
    out = detections.locate(df.select("image").distinct(), stored, df, "image", 40.0, 40.0)
    assert out.count() == 10 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
