"""Tabular stage: feature rows, label clamps, phase rows, ferns and box selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cinestat.session import kept

from cinestat.functions.cdf import clamp
from cinestat.operators.histograms import exact_percentiles


def label_range(labels: DataFrame, value: str) -> Column:
    """1st, 50th and 99th percentile of a label column as a scalar struct."""
    q = exact_percentiles(labels, value, [0.01, 0.5, 0.99])
    return q.select(F.struct(F.col("q0").alias("p1"), F.col("q1").alias("p50"), F.col("q2").alias("p99")).alias("q")).scalar()


def phase_rows(
    features: DataFrame, labels: DataFrame, key: str, systole: str = "systole", diastole: str = "diastole"
) -> DataFrame:
    """Clamp the volume columns to the label range, add their means, emit two rows per key."""
    s, d = F.col("__sys"), F.col("__dias")
    ranged = features.select(
        "*", label_range(labels, systole).alias("__sys"), label_range(labels, diastole).alias("__dias")
    )
    clamped = ranged.withColumns({
        **{c: clamp(F.col(c), s["p1"], s["p99"]) for c in ("v_min", "v_min_cpr")},
        **{c: clamp(F.col(c), d["p1"], d["p99"]) for c in ("v_max", "v_max_cpr")},
    })
    means = clamped.withColumns({
        "mean_sys": (F.col("v_min_cpr") + F.col("v_min")) / 2,
        "mean_dias": (F.col("v_max") + F.col("v_max_cpr")) / 2,
    })
    means = means.drop("__sys", "__dias")
    joined = means.join(labels.select(key, systole, diastole), key)
    phases = F.array(
        F.struct(F.lit(0).alias("is_diastole"), F.col(systole).alias("label")),
        F.struct(F.lit(1).alias("is_diastole"), F.col(diastole).alias("label")),
    )
    return joined.select(*means.columns, F.inline(phases))


def unmatched(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Feature rows without a label; the original fails on the first of them."""
    return features.join(labels.select(key), key, "left_anti")


def fern_index(pairs: list[tuple[Column, Column]], thresholds: list[float]) -> Column:
    """Sum of 2^j over the pairs whose difference reaches its threshold."""
    bits = [
        F.when(a - b >= F.lit(t), 1 << j).otherwise(0) for j, ((a, b), t) in enumerate(zip(pairs, thresholds))
    ]
    total = bits[0]
    for b in bits[1:]:
        total = total + b
    return total


def fern_bins(df: DataFrame, index: Column, targets: list[str], beta: float = 1000.0) -> DataFrame:
    """Shrunken mean target per fern bin: sum / ((1 + beta/n) n)."""
    n = F.count("*")
    return df.groupBy(index.alias("bin")).agg(
        n.alias("n"), *[(F.sum(t) / ((1.0 + F.lit(beta) / n) * n)).alias(t) for t in targets]
    )


def covariance_long(df: DataFrame, px: str) -> DataFrame:
    """Population covariance of all positions of an array column, ``(i, j, cov)``, i <= j.

    Each task multiplies its batches and emits one triangle of sums; the shuffle
    therefore carries positions squared per task, whatever the number of rows.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, g = 0, None, None
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[px].to_numpy()).astype(float)
            n += len(x)
            s = x.sum(0) if s is None else s + x.sum(0)
            g = x.T @ x if g is None else g + x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": n, "si": s[i], "sj": s[j], "g": g[i, j]})

    parts = df.select(px).mapInPandas(partial, "i int, j int, n long, si double, sj double, g double")
    t = parts.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "si", "sj", "g")])
    return t.select("i", "j", (F.col("g") / F.col("n") - F.col("si") * F.col("sj") / (F.col("n") * F.col("n"))).alias("cov"))


def strongest_pairs(cov: DataFrame, target_cov: DataFrame) -> DataFrame:
    """Score every pixel pair by |cov(t,m) - cov(t,n)| / std(m - n).

    The input is the covariance table of the candidates (their number squared), which
    already is the set of pairs, so no rows are crossed.
    """
    diag = cov.where(F.col("i") == F.col("j"))
    vi = diag.select(F.col("i"), F.col("cov").alias("vi"))
    vj = diag.select(F.col("i").alias("j"), F.col("cov").alias("vj"))
    ti = target_cov.select(F.col("i"), F.col("tc").alias("ti"))
    tj = target_cov.select(F.col("i").alias("j"), F.col("tc").alias("tj"))
    rows = cov.where(F.col("i") < F.col("j")).join(vi, "i").join(vj, "j").join(ti, "i").join(tj, "j")
    den = F.sqrt(F.greatest(F.col("vi") + F.col("vj") - 2 * F.col("cov"), F.lit(0.0)))
    return rows.where(den > 1e-10).select("i", "j", (F.abs(F.col("ti") - F.col("tj")) / den).alias("score"))


def target_covariance(df: DataFrame, px: str, target: Column) -> DataFrame:
    """Population covariance of a scalar target with every array position."""
    long = df.select(target.alias("t"), F.posexplode(px).alias("i", "v"))
    return long.groupBy("i").agg(F.covar_pop("t", "v").alias("tc"))


def nearest_point(points: Column, x: Column, y: Column) -> Column:
    """Closest entry of a short point array; the lowest index wins ties."""
    ranked = F.transform(
        points, lambda p, i: F.struct(((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y)).alias("d"), i.alias("i"))
    )
    return F.array_min(ranked)


def nearest_box(
    boxes: DataFrame, key: str, cx: Column, cy: Column, order: list[Column], width: float
) -> DataFrame:
    """Detected box nearest to a point per key, or a 20x20 default beyond width/4.

    ``boxes(key, x, y, w, h)``; one map-side combined aggregation.
    """
    d = F.sqrt((F.col("x") + F.col("w") / 2 - cx) ** 2 + (F.col("y") + F.col("h") / 2 - cy) ** 2)
    best = boxes.groupBy(key).agg(
        F.min_by(F.struct("x", "y", "w", "h", d.alias("d")), F.struct(d, *order)).alias("b")
    )
    near = F.col("b.d") < F.lit(0.25 * width)
    fallback = {"x": cx - 10, "y": cy - 10, "w": F.lit(20.0), "h": F.lit(20.0)}
    return best.select(
        key, near.alias("detected"), *[F.when(near, F.col(f"b.{c}")).otherwise(v).alias(c) for c, v in fallback.items()]
    )


def negative_boxes(
    positives: DataFrame, key: list[str], width: int, height: int, *, wanted: int = 5, seed: int = 42,
    draws: int = 16, most: int = 1 << 20,
) -> DataFrame:
    """Seeded random boxes that cover at most a fifth of the positive box.

    Sizes run from 24 to 87, or to the image's shorter side.  The first ``wanted``
    accepted draws are kept, like a rejection loop: keys that are short after a round
    repeat it with sixteen times the draws, which cannot change an earlier acceptance,
    until no key is short.  A key without enough after ``most`` draws is an error.
    """
    if min(width, height) <= 24:
        raise ValueError(f"no box of 24 pixels fits an image of {width} x {height}")
    left, done = positives, None
    while True:
        tried = kept(_accepted_boxes(left, key, width, height, wanted, seed, draws))
        full = tried.where(F.size("b") == wanted)
        done = full if done is None else done.unionByName(full)
        left = kept(left.join(full.select(*key), key, "left_anti"))
        short = left.select(*key).take(3)
        if not short:
            return done.select(*key, F.inline("b"))
        if draws >= most:
            raise ValueError(f"fewer than {wanted} boxes in {draws} draws for {[tuple(r) for r in short]}")
        draws *= 16


def _accepted_boxes(
    positives: DataFrame, key: list[str], width: int, height: int, wanted: int, seed: int, draws: int
) -> DataFrame:
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key], F.col("draw").cast("string"))
    drawn = positives.select("*", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.withColumn("hash", F.md5(name))

    def number(part: int, below: Column) -> Column:
        text = F.substring("hash", 1 + 8 * part, 8)
        return F.pmod(F.conv(text, 16, 10).cast("bigint"), below.cast("bigint")).cast("int")

    drawn = drawn.withColumn("size", number(0, F.lit(min(64, min(width, height) - 24))) + 24)
    drawn = drawn.withColumn("nx", number(1, F.lit(width) - F.col("size")))
    drawn = drawn.withColumn("ny", number(2, F.lit(height) - F.col("size")))
    ow = F.greatest(F.least(F.col("nx") + F.col("size"), F.col("x") + F.col("w")) - F.greatest("nx", "x"), F.lit(0))
    oh = F.greatest(F.least(F.col("ny") + F.col("size"), F.col("y") + F.col("h")) - F.greatest("ny", "y"), F.lit(0))
    ok = drawn.where(ow * oh <= F.lit(0.2) * F.col("w") * F.col("h"))
    return ok.groupBy(*key).agg(
        F.slice(F.array_sort(F.collect_list(F.struct("draw", "nx", "ny", "size"))), 1, wanted).alias("b")
    )
