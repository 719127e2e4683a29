"""Small operators that no registered query shows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinestat.functions import cdf, geometry
from cinestat.operators import features, keyed, pixels, superpixels
from cinestat.sources import tables


def test_regularized_step_and_delta(spark):
    x = spark.createDataFrame([(float(v) / 50 - 40,) for v in range(4001)], "x double")
    r = x.agg(F.sum(cdf.regularized_delta(F.col("x"))).alias("mass"), F.max(cdf.regularized_delta(F.col("x"))).alias("top")).first()
    assert r.mass / 50 == pytest.approx(1, abs=0.02) and r.top == pytest.approx(1 / np.pi)


def test_rectangles_hold_their_near_edges_only(spark):
    df = spark.createDataFrame([(0, 0), (4, 2), (5, 2), (4, 3), (-1, 0)], "x int, y int")
    box = [F.lit(0), F.lit(0), F.lit(5), F.lit(3)]
    got = [r.c for r in df.select(geometry.rect_contains(box, F.col("x"), F.col("y")).alias("c")).collect()]
    assert got == [True, True, False, False, False]


def test_unlabelled_features(spark):
    a, b = spark.range(5).toDF("k"), spark.range(1, 4).toDF("k")
    assert sorted(r.k for r in features.unmatched(a, b, "k").collect()) == [0, 4]


def test_transpose_and_cyclic_arrays(spark):
    img = np.arange(12).reshape(3, 4)
    df = spark.createDataFrame([(img.ravel().tolist(),)], "px array<long>")
    t = df.select(pixels.transpose(F.col("px"), 4, 3).alias("t"), pixels.pad_count(F.col("px"), 14).alias("p")).first()
    assert t.t == img.T.ravel().tolist() and t.p == [*range(12), 0, 1]


def test_histogram_overlap(spark):
    df = spark.createDataFrame([([1.0, 1.0, 2.0], [2.0, 0.0, 2.0])], "a array<double>, b array<double>")
    assert df.select(superpixels.histogram_overlap(F.col("a"), F.col("b")).alias("o")).first().o == pytest.approx(0.75)


def test_split_and_metrics_tables(spark, tmp_path):
    df = spark.range(6).withColumn("part", F.when(F.col("id") < 4, "train").otherwise("validate"))
    tables.write_split(df, f"{tmp_path}/s", "part")
    assert spark.read.parquet(f"{tmp_path}/s/part=validate").count() == 2
    for epoch in (1, 2):
        tables.append_metrics(spark.createDataFrame([(epoch, 0.5 / epoch)], "epoch int, loss double"), f"{tmp_path}/m")
    assert spark.read.parquet(f"{tmp_path}/m").count() == 2


def test_hot_keys_join_like_cold_ones(spark):
    df = spark.range(1000).select((F.col("id") % 7 * (F.col("id") > 700).cast("int")).alias("k"), F.lit(1).alias("same"))
    stats = df.groupBy("k").agg(F.count("*").alias("n"), F.sum("same").alias("s"))
    plain = keyed.attach_group(df, stats, ["k"], "n").groupBy("k", "s").count().collect()
    salted = keyed.attach_group(df, stats, ["k"], "n", hot_rows=50).groupBy("k", "s").count().collect()
    assert sorted(map(tuple, plain)) == sorted(map(tuple, salted)) and sum(r["count"] for r in salted) == 1000
