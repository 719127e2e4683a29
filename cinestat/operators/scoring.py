"""Scores of predicted distributions and of predicted ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.functions import cdf
from cinestat.session import spread


def mean_cdf(preds: DataFrame, key: str, mu: Column, sigma: float, *carry: str) -> DataFrame:
    """Average Gaussian CDF of all predictions of a key, long form.

    Only the narrow prediction rows are shuffled (once, on ``key``); the BINS-fold
    expansion, the average and any later window on ``key`` share that stage.
    ``preds`` must be pre-aggregated to a bounded number of rows per key.
    """
    placed = spread(preds, key).select(key, mu.alias("mu"), *carry)
    long = placed.select("*", F.explode(cdf.bins()).alias("bin"))
    return long.groupBy(key, "bin").agg(
        F.avg(cdf.norm_cdf(F.col("bin"), F.col("mu"), F.lit(sigma))).alias("p"),
        *[F.max(c).alias(c) for c in carry],
    )


def monotone(long: DataFrame, key: str, p: str = "p") -> DataFrame:
    """Running maximum along the bins; no extra shuffle when already placed by key."""
    w = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return long.withColumn(p, F.max(p).over(w))


def crps_by_key(long: DataFrame, key: str, truth: str) -> DataFrame:
    """Squared distance of ``p`` to the strict step at ``truth``, averaged over bins."""
    step = cdf.step_cdf(F.col("bin"), F.col(truth), "strict")
    return long.groupBy(key).agg(
        (F.sum((F.col("p") - step) * (F.col("p") - step)) / F.lit(float(cdf.BINS))).alias("crps")
    )


def sigma_search(
    pairs: DataFrame, pred: str, truth: str, *, truth_sigma: float = 0.01,
    first: float = 1.5, step: float = 0.5, count: int = 57,
) -> DataFrame:
    """CRPS of every spread on a fixed grid, the early-stop mark and the best spread.

    The aggregate keeps ``count`` groups, so the shuffle is tiny.
    """
    grid = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda n: F.lit(first) + n * F.lit(step))
    rows = spread(pairs, pred, truth).select(
        F.col(pred).alias("mu"), F.col(truth).alias("v"), F.explode(grid).alias("sigma")
    )
    rows = rows.select("*", F.explode(cdf.bins()).alias("bin"))
    gap = cdf.norm_cdf(F.col("bin"), F.col("mu"), F.col("sigma")) - cdf.norm_cdf(
        F.col("bin"), F.col("v"), F.lit(truth_sigma)
    )
    total = pairs.agg(F.count("*").alias("n")).scalar()
    scored = rows.groupBy("sigma").agg(
        (F.sum(gap * gap) / (total * F.lit(float(cdf.BINS)))).alias("crps")
    )
    # Windows without a key: the input is the grid itself, `count` rows.
    along = Window.orderBy("sigma")
    ascending = (F.lag("crps", 2).over(along) <= F.lag("crps", 1).over(along)) & (
        F.lag("crps", 1).over(along) <= F.col("crps")
    )
    marked = scored.withColumn(
        "stop", F.coalesce(ascending & (F.row_number().over(along) > 3), F.lit(False))
    )
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    marked = marked.withColumn(
        "evaluated", ~F.coalesce(F.bool_or("stop").over(before), F.lit(False))
    )
    ranked = Window.orderBy(F.col("evaluated").desc(), "crps", "sigma")
    return marked.select(
        "sigma", "crps", "evaluated", (F.row_number().over(ranked) == 1).alias("best")
    )


def weighted_kappa(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """Quadratic-weighted agreement of two integer ratings.

    The expected disagreement needs only the moments of the marginals:
    E(i-j)^2 = E(i^2) - 2 E(i) E(j) + E(j^2), so no table of rating pairs is built.
    """
    i, j = F.bround(F.col(truth).cast("double")), F.bround(F.col(pred).cast("double"))
    m = pairs.agg(
        F.count("*").alias("n"),
        F.avg((i - j) * (i - j)).alias("observed"),
        (F.avg(i * i) - F.lit(2.0) * F.avg(i) * F.avg(j) + F.avg(j * j)).alias("expected"),
    )
    return m.select(
        "n",
        F.when(F.abs("expected") < 1e-12, 1.0)
        .otherwise(F.lit(1.0) - F.try_divide("observed", "expected"))
        .alias("kappa"),
    )


def confusion(pairs: DataFrame, truth: str, pred: str) -> DataFrame:
    """Counts per (rating, rating) and the product of the marginals."""
    i = F.bround(F.col(truth).cast("double")).cast("int")
    j = F.bround(F.col(pred).cast("double")).cast("int")
    cells = pairs.groupBy(i.alias("rating"), j.alias("predicted")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return cells.select(
        "rating", "predicted", "n",
        (
            F.sum("n").over(Window.partitionBy("rating"))
            * F.sum("n").over(Window.partitionBy("predicted")) / total
        ).alias("expected"),
    )


def band_spread(
    errors: DataFrame, truth: str, error: str, width: float = 100.0, bands: int = 5
) -> DataFrame:
    """Population deviation of the error inside open intervals of the truth."""
    t = F.col(truth)
    band = F.floor(t / F.lit(width)).cast("int")
    inside = errors.where((t > 0) & (t < width * bands) & (F.pmod(t, F.lit(width)) != 0))
    return inside.groupBy(band.alias("band")).agg(
        F.count("*").alias("n"), F.stddev_pop(error).alias("error_std")
    )
