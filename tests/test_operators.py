"""Operators against brute force and exact examples."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinestat.functions import cdf, hog, shapes, stencils
from cinestat.operators.pixels import explode_pixels
from cinestat.session import settle
from cinestat.operators import augment, features, histograms, keyed, label_graph as mrf, ranking, ring, shape_regression as sr, superpixels


def value(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def pts(points):
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in points])


def test_exact_examples(spark):
    ends = [F.struct(F.lit(a).alias("x"), F.lit(b).alias("y")) for a, b in ((0, 0), (3, 4))]
    line = [(p.x, p.y) for p in value(spark, shapes.line_points(*ends))]
    assert line == [(0, 0), (1, 1), (1, 2), (2, 3), (3, 4)]
    assert [(p.x, p.y) for p in value(spark, shapes.line_points(*ends[::-1]))] == line[::-1]
    box = [(0, 0), (2, 0), (2, 1), (0, 1)]
    assert value(spark, shapes.polygon_area(pts(box))) == 2.0
    assert value(spark, shapes.polygon_area(pts(box[::-1]))) == -2.0
    assert value(spark, shapes.polygon_area(pts(box[:2]))) == 0.0
    assert value(spark, cdf.running_max(arr(0.1, 0.3, 0.2, 0.5, 0.4))) == [0.1, 0.3, 0.3, 0.5, 0.5]
    assert value(spark, cdf.crps(arr(0, 1, 1), arr(0.2, 0.5, 0.9))) == pytest.approx(0.1)
    assert [value(spark, cdf.step_cdf(F.lit(10), F.lit(10.0), c)) for c in ("strict", "half", "closed")] == [0.0, 0.5, 1.0]
    assert value(spark, cdf.ordinal_encode(F.lit(2), 4)) == [1.0, 1.0, 0.0, 0.0]
    assert value(spark, cdf.ordinal_decode(arr(1, 1, 0, 1))) == 2
    assert value(spark, cdf.ordinal_decode(arr(1, 1))) == 2
    assert value(spark, ring.upper_median(arr(4, 1, 3, 2))) == 3.0
    row = spark.range(1).select(ring.ring_frame(F.lit(1), -1).alias("a"), ring.ring_frame(F.lit(30), 1).alias("b")).first()
    assert (row.a, row.b) == (30, 1)


def test_norm_cdf_error(spark):
    xs = spark.range(-600, 600).select((F.col("id") / 100).alias("x"))
    rows = xs.select("x", cdf.norm_cdf(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("p")).collect()
    assert max(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) for r in rows) < 1e-7


def test_hot_keys_give_the_same_rows(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", (F.col("user_id") % 5).alias("k"), "value")
    ev = ev.withColumn("k", F.when(F.col("event_id") % 3 == 0, 99).otherwise(F.col("k")))
    stats = ev.groupBy("k").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    a = keyed.attach_group(ev, stats, ["k"], "n", hot_rows=20)
    b = ev.join(stats.drop("n"), "k").select(*a.columns)
    assert a.count() == ev.count() and a.exceptAll(b).count() == 0
    modal = [keyed.modal_rows(ev, ["k"], F.col("value").cast("int"), hot_rows=h) for h in (10, 10**9)]
    assert modal[0].exceptAll(modal[1]).count() == 0 and modal[0].count() == modal[1].count()


def test_modal_tie_takes_smallest(spark):
    df = spark.createDataFrame([(1, v) for v in (3, 1, 3, 1, 2)], "k int, v int")
    assert {r.v for r in keyed.modal_rows(df, ["k"], F.col("v")).collect()} == {1}


@pytest.mark.parametrize("parts", [1, 7])
def test_global_rank(spark, parts):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), "id").repartition(parts)
    rows = ranking.global_row_number(df, ["v", "id"]).orderBy("rn").collect()
    assert [r.rn for r in rows] == list(range(1, 1001))
    assert [(r.v, r.id) for r in rows] == sorted((r.v, r.id) for r in rows)


def test_exact_percentiles_with_skew(spark):
    vals = [5.0] * 400 + [float(i * i % 97) for i in range(300)] + [1e6]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    q = histograms.exact_percentiles(df, "v", [0.0, 0.01, 0.37, 0.5, 0.99, 1.0], n_bins=16).first()
    assert list(q) == pytest.approx(np.percentile(vals, [0, 1, 37, 50, 99, 100]).tolist())
    one = histograms.exact_percentiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.5]).first()
    assert one.q0 == 3.0


def test_outlier_runs(spark):
    spike = [20.0] * 4 + [60.0] + [20.0] * 5
    assert value(spark, ring.outlier_flags(arr(*spike))) == [0, 0, 0, 0, 1, 0, 0, 0, 0, 0]
    level = [20.0] * 5 + [90.0] * 5
    assert value(spark, ring.outlier_flags(arr(*level))) == [0] * 5 + [1] * 5
    assert value(spark, ring.outlier_flags(arr(*[20.0 + i % 2 for i in range(10)]))) == [0] * 10


def test_cycle_padding(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate("abc")], "k int, i int, v string")
    out = ring.pad_cycle(df, ["k"], "i", 7).orderBy("pos").collect()
    assert "".join(r.v for r in out) == "abcabca"
    assert ring.pad_cycle(df, ["k"], "i", 2).count() == 2


def test_chain_labels(spark):
    sites = spark.createDataFrame([(0, i, c) for i, c in enumerate([[0.0, 5.0], [4.0, 3.0], [4.0, 3.0], [9.0, 1.0]])],
                                  "g int, site int, costs array<double>")
    edges = spark.createDataFrame([(0, a, b, 1.0) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2))],
                                  "g int, src int, dst int, times double")
    smooth = mrf.potts([0, 1], 3.0)
    for flag in (False, True):
        out = mrf.belief_propagation(sites, edges, "g", [0, 1], smooth, 5, by_vertex=flag)
        assert [r.label for r in out.orderBy("site").collect()] == [0, 1, 1, 1]
    icm = mrf.iterated_modes(sites, edges, "g", [0, 1], smooth, 5).orderBy("site").collect()
    assert [r.label for r in icm] == [0, 1, 1, 1]

    def step(rounds):
        lab = mrf.belief_propagation(sites, edges, "g", [0, 1], smooth, rounds)
        return lab, mrf.energy(lab, edges, "g", [0, 1], smooth)

    best = mrf.until_no_gain(step, 5)
    assert [r.label for r in best.orderBy("site").collect()] == [0, 1, 1, 1]
    assert mrf.energy(best, edges, "g", [0, 1], smooth).first().energy == 0 + 3 + 3 + 1 + 2 * 3


def test_superpixels_cover_and_do_not_shuffle_pixels(spark):
    rng = np.random.default_rng(0)
    imgs = spark.createDataFrame([(i, rng.random(12 * 10).tolist()) for i in range(3)], "id int, px array<double>")
    out = superpixels.slic(imgs, "id", "px", 12, 10, superpixels=12, nc=0.5, iterations=3, radius=2, cut_every=2)
    rows = out.collect()
    assert len(rows) == 360 and len({(r.id, r.y, r.x) for r in rows}) == 360
    assert sum(r.label >= 0 for r in rows) > 340  # moved seeds may leave a corner outside every window
    centres = superpixels.seed_centres(imgs, "id", "px", 12, 10, 3, 2)
    state = settle(superpixels.place_pixels(explode_pixels(imgs, "id", "px", 12), "id", 6, centres))
    nxt = superpixels.assign(state, centres, "id", 6, 4.5, superpixels.slic_distance(0.5, 3))
    pixel_side = nxt._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    assert "Exchange" not in pixel_side[: pixel_side.index("InMemoryTableScan")]
    assert "Sort " not in pixel_side[: pixel_side.index("InMemoryTableScan")]


def test_level_set_finds_disc():
    yy, xx = np.mgrid[0:24, 0:24]
    img = (np.hypot(yy - 12, xx - 11) < 6).astype(float)[None]
    init = 9.0 - np.hypot(yy - 11.5, xx - 11.5)
    u, settled = stencils.chan_vese(img, init, steps=400, mu=0.1, lambda1=5, lambda2=5)
    assert ((u[0] > 0) == (img[0] > 0.5)).mean() > 0.97


def test_stencils():
    rng = np.random.default_rng(1)
    a = rng.random((3, 9, 7))
    flat = np.full((1, 6, 6), 3.0)
    assert np.allclose(stencils.perona_malik(flat, 1.0, 0.1, 0.5), flat)
    assert np.allclose(stencils.gradient_magnitude(flat), 0)
    smooth, settled = stencils.tv_denoise(a, 0.3)
    assert np.abs(np.diff(smooth, axis=2)).sum() < np.abs(np.diff(a, axis=2)).sum()
    assert np.allclose(smooth.mean((1, 2)), a.mean((1, 2)))
    one = np.concatenate([stencils.tv_denoise(a[i : i + 1], 0.3)[0] for i in range(3)])
    assert np.allclose(one, smooth)  # images of a batch do not influence each other


def test_hog_and_detection(spark):
    rng = np.random.default_rng(2)
    img = rng.random((2, 32, 32)) * 255
    d = hog.descriptor(img)
    assert d.shape == (2, 324) and np.allclose(np.sqrt((d.reshape(2, 9, 36) ** 2).sum(-1)), 1, atol=1e-2)
    ramp = np.tile(np.arange(32.0), (32, 1))[None]
    hist = hog.descriptor(ramp).reshape(9, 4, 9).sum((0, 1))
    assert hist.argmax() in (0, 8)
    big = rng.random((40, 48)) * 20
    big[4:36, 8:40] = img[0]
    df = spark.createDataFrame([(1, big.ravel().tolist())], "id int, px array<double>")
    w = hog.descriptor(img[:1])[0]
    found = hog.detect(df, "id", "px", 48, w, -6.0).orderBy(F.desc("score")).first()
    assert abs(found.x - 8) <= 4 and abs(found.y - 4) <= 4


def test_augmentation_is_seeded(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.random(100).tolist()) for i in range(6)], "id int, px array<double>")
    for kernel in (augment.rotate(20), augment.shift(0.2, 0.2), augment.jitter(), augment.affine((9, 9)), augment.random_crop(6, 5)):
        a, b = ({r.id: r.px for r in augment.seeded_map(d, "id", "px", 10, kernel, 7).collect()} for d in (df.coalesce(1), df.repartition(4)))
        assert a == b
    img = rng.random((10, 10))
    assert np.allclose(augment.warp(img, augment.about_centre(augment.rotation(90), img.shape), img.shape), np.rot90(img, 1)) or np.allclose(
        augment.warp(img, augment.about_centre(augment.rotation(90), img.shape), img.shape), np.rot90(img, -1))


def test_shape_regression(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = []
    yy, xx = np.mgrid[0:32, 0:32]
    for i in range(60):
        cx, cy, rx, ry = rng.uniform(13, 19, 2).tolist() + rng.uniform(4, 8, 2).tolist()
        img = np.where(((xx - cx) / rx) ** 2 + ((yy - cy) / ry) ** 2 <= 1, 200.0, 20.0)
        t = np.arange(6) * np.pi / 3
        p = [(float(cx + rx * np.cos(a)), float(cy + ry * np.sin(a) + 0.2 * np.cos(a))) for a in t]
        box = dict(start_x=6.0, start_y=6.0, width=20.0, height=20.0, centroid_x=16.0, centroid_y=16.0)
        rows.append((i, img.ravel().tolist(), 32, box, [dict(x=a, y=b) for a, b in p]))
    schema = ("id int, px array<double>, width int, box struct<start_x:double,start_y:double,width:double,height:double,"
              "centroid_x:double,centroid_y:double>, pts array<struct<x:double,y:double>>")
    df = spark.createDataFrame(rows, schema)
    model = sr.train(df, "id", cascades=2, ferns=3, candidates=40, pairs=3, starts=4, beta=5.0, seed=1, rewrite_every=2)
    sr.model_table(spark, model).write.parquet(str(tmp_path / "m"))
    again = sr.load_model(spark.read.parquet(str(tmp_path / "m")))
    truth = {r[0]: np.array([(p["x"], p["y"]) for p in r[4]]) for r in rows}
    start = sr.Model(model.mean, [])

    def error(m, starts=1):
        out = {r.id: np.array([(p.x, p.y) for p in r.pts]) for r in sr.predict(df, "id", m, starts).collect()}
        return np.mean([np.hypot(*(out[i] - truth[i]).T).mean() for i in truth])

    assert error(again) == pytest.approx(error(model)) and error(model) < 0.9 * error(start)
    assert error(model, 3) > 0


def test_grouped_fit(spark):
    from cinestat.models import regress

    rng = np.random.default_rng(0)
    rows = [(i, i // 2, *(x := rng.random(2)).tolist(), float(3 * x[0] - x[1] + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, who int, a double, b double, label double")
    folded = ranking.group_folds(df, "who", 4)
    assert folded.groupBy("who").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    pred, models = regress.out_of_fold(folded, ["a", "b"], regress.linear(), k=4, normalize=True)
    assert pred.select(F.max(F.abs(F.col("prediction") - F.col("label"))).alias("e")).first().e < 1e-6
    mean = regress.ensemble_mean(models, df, ["id", "label"])
    assert mean.select(F.max(F.abs(F.col("prediction") - F.col("label"))).alias("e")).first().e < 1e-6
    tree = regress.fit(df, ["a", "b"], regress.boosted_trees(trees=5))
    top = regress.relative_importance(tree, ["a", "b"], spark).first()
    assert top.feature == "a" and top.relative == 100.0
    half = df.withColumn("y", (F.col("a") > 0.5).cast("int")).withColumn("d", F.array("a", "b"))
    w, _ = regress.train_detector(half, "d", "y", [0.001, 0.1], folds=3)
    assert abs(w[0]) > abs(w[1])


def test_delivery(spark, tmp_path):
    from cinestat.streaming.batches import deliver

    src = str(tmp_path / "in")
    spark.range(10).selectExpr("id", "id * 2.0D as v").repartition(3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):
        q = deliver(spark, src, schema, lambda b: b.withColumn("v", F.col("v") + 1), str(tmp_path / "out"), str(tmp_path / "ck"), 2)
        q.awaitTermination(60)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 10 and out.select("batch").distinct().count() == 2
    assert out.agg(F.sum("v")).first()[0] == 100.0


def test_negative_boxes_reach_the_wanted_number(spark):
    df = spark.createDataFrame([(1, 10, 10, 30, 30), (2, 40, 40, 200, 200)], "id int, x int, y int, w int, h int")
    out = features.negative_boxes(df, ["id"], 256, 256).collect()
    assert {i: sum(r.id == i for r in out) for i in (1, 2)} == {1: 5, 2: 5}
    for r in out:
        x, y, w, h = {1: (10, 10, 30, 30), 2: (40, 40, 200, 200)}[r.id]
        ow, oh = min(r.nx + r.size, x + w) - max(r.nx, x), min(r.ny + r.size, y + h) - max(r.ny, y)
        assert max(ow, 0) * max(oh, 0) <= 0.2 * w * h


def test_map_images_handles_sizes_and_nulls(spark):
    rows = [(1, list(map(float, range(12)))), (2, None), (3, list(map(float, range(8)))), (4, [1.0] * 12)]
    df = spark.createDataFrame(rows, "id int, px array<double>").coalesce(1)
    out = {r.id: r.o for r in stencils.map_images(df, "px", lambda a: a * 2, 4, "o").collect()}
    assert out[2] is None and out[1] == [2.0 * i for i in range(12)] and out[3] == [2.0 * i for i in range(8)] and out[4] == [2.0] * 12


def test_kernels_get_stacks_of_bounded_size(spark):
    n = stencils.STACK_PIXELS // 1024 + 9
    df = spark.range(n).select("id", F.expr("transform(sequence(1, 1024), i -> double(id + i))").alias("px")).coalesce(1)
    out = stencils.map_images(df, "px", lambda a: np.stack([np.full(len(a), len(a)), a[:, 0, 0]], 1), 32, "o").collect()
    assert len(out) == n and all(r.o[0] * 1024 <= stencils.STACK_PIXELS and r.o[1] == r.id + 1 for r in out)


def test_descriptors_do_not_depend_on_the_stack(spark, monkeypatch):
    rng = np.random.default_rng(3)
    px = rng.random((5, 32, 32))
    df = spark.createDataFrame([(i, p.ravel().tolist()) for i, p in enumerate(px)], "id int, px array<double>").coalesce(1)
    want = hog.descriptor(px)
    monkeypatch.setattr(stencils, "STACK_PIXELS", 2048)
    assert np.allclose([r.d for r in hog.descriptors(df, "px", "d").orderBy("id").collect()], want)


def test_sweeps_in_parts_equal_one_sweep(spark):
    rng = np.random.default_rng(8)
    rows = [(g, s, rng.integers(0, 40, 3).astype(float).tolist()) for g in range(7) for s in range(12)] + [(9, 0, [3.0, 1.0, 2.0])]
    sites = spark.createDataFrame(rows, "g int, site int, costs array<double>").coalesce(1)
    edges = mrf.grid_edges(sites.where("g < 9"), "g", 4, 3)
    smooth = mrf.potts([1, 2, 0], 7.0, unknown=0)
    one, few = (sorted(map(tuple, mrf.iterated_modes(sites, edges, "g", [1, 2, 0], smooth, 3, sites_at_once=k).collect())) for k in (1, 30))
    assert one == few and len(one) == len(rows)


def test_settling_gathers_no_table_at_the_driver(spark):
    sites = spark.createDataFrame([(g, s, [float((g * s) % 7), 3.0]) for g in range(4) for s in range(9)], "g int, site int, costs array<double>")
    edges = mrf.grid_edges(sites, "g", 3, 3)
    for solver in mrf.SOLVERS:
        out = mrf.settle_labels(sites, edges, "g", [0, 1], mrf.potts([0, 1], 3.0), solver=solver)
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in mrf.energy(mrf.initial_labels(sites, "g", [0, 1]), edges, "g", [0, 1], mrf.potts([0, 1], 3.0))._jdf.queryExecution().executedPlan().toString()


def test_images_at_rest_leave_the_rounds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    imgs = spark.createDataFrame([(i, rng.random(64).tolist()) for i in range(12)], "id int, px array<double>")
    sent = []
    whole = superpixels.assign
    monkeypatch.setattr(superpixels, "assign", lambda pixels, centres, *rest: (sent.append((pixels.count(), centres.count())), whole(pixels, centres, *rest))[1])

    def run():
        return sorted(map(tuple, superpixels.slic(imgs, "id", "px", 8, 8, superpixels=16, nc=0.2, radius=1, iterations=16).collect()))

    early = run()
    assert len(early) == 12 * 64 and sent[-1][0] < 12 * 64 and sent[-1][1] < sent[0][1]
    monkeypatch.setattr(superpixels, "CHECKED", 100)
    assert run() == early
    near = superpixels.seed_centres(imgs, "id", "px", 8, 8, 2, 1).select(F.size(superpixels._touched("cx", 8, 3.0, 8)).alias("n"))
    assert near.agg(F.max("n")).first()[0] == 1  # a centre is sent to the cells it can reach only
