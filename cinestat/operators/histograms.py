"""Histograms, empirical distributions and exact order statistics.

Everything here aggregates to (key, value) or (key, bin) counts before it shuffles,
so a key that owns most of the rows is spread over many groups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.functions import cdf
from cinestat.operators.keyed import attach_group


def empirical_cdf(df: DataFrame, keys: list[str], value: str, n_bins: int = cdf.BINS) -> DataFrame:
    """Closed empirical CDF per key: share of rows with ceil(value) <= bin, all bins."""
    capped = F.greatest(F.least(F.ceil(value), F.lit(n_bins)), F.lit(0)).cast("int")
    counts = df.groupBy(*keys, capped.alias("b")).agg(F.count("*").alias("n"))
    along = Window.partitionBy(*keys).orderBy("b")
    whole = Window.partitionBy(*keys)
    steps = counts.select(
        *keys, "b",
        (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
         / F.sum("n").over(whole)).alias("p"),
        F.coalesce(F.lead("b").over(along), F.lit(n_bins)).alias("nxt"),
        (F.row_number().over(along) == 1).alias("is_first"),
    )

    def run(lo: Column, hi: Column, p: Column) -> Column:
        return F.when(
            lo <= hi,
            F.transform(F.sequence(lo, hi), lambda j: F.struct(j.alias("bin"), p.alias("p"))),
        ).otherwise(F.array().cast("array<struct<bin:int,p:double>>"))

    # A step holds until the next occupied bin; the first one also emits the zeros before it.
    head = F.when(F.col("is_first"), F.col("b") - 1).otherwise(F.lit(-1))
    last = F.col("nxt") - 1
    emitted = F.concat(run(F.lit(0), head, F.lit(0.0)), run(F.col("b"), last, F.col("p")))
    return steps.select(*keys, F.inline(emitted))


def empirical_cdf_arrays(df: DataFrame, keys: list[str], value: str, n_bins: int = cdf.BINS) -> DataFrame:
    """The same distribution as one array ``p`` per key, without a row per bin.

    A key sends its occupied bins and their counts (``n_bins + 1`` pairs at most); the array
    is written stretch by stretch from them.
    """
    capped = F.greatest(F.least(F.ceil(value), F.lit(n_bins)), F.lit(0)).cast("int")
    counts = df.groupBy(*keys, capped.alias("b")).agg(F.count("*").alias("n"))
    held = counts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("steps"), F.sum("n").alias("total"))

    def state(seen: Column, at: Column, out: Column) -> Column:
        return F.struct(seen.alias("seen"), at.alias("at"), out.alias("out"))

    def upto(acc: Column, b: Column) -> Column:
        return F.concat(acc["out"], F.array_repeat(acc["seen"] / F.col("total"), b - acc["at"]))

    start = state(F.lit(0).cast("long"), F.lit(0), F.array().cast("array<double>"))
    step = lambda acc, e: state(acc["seen"] + e["n"], e["b"], upto(acc, e["b"]))
    return held.select(*keys, F.aggregate("steps", start, step, lambda acc: upto(acc, F.lit(n_bins))).alias("p"))


def pmf(long: DataFrame, keys: list[str]) -> DataFrame:
    """First difference along the bins (the first bin has no predecessor and is dropped)."""
    w = Window.partitionBy(*keys).orderBy("bin")
    diff = long.withColumn("mass", F.col("p") - F.lag("p").over(w))
    return diff.where(F.col("bin") > 0).select(*keys, (F.col("bin") - 1).alias("bin"), "mass")


def cdf_moments(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and variance of a discretised CDF (mass sits at the middle of a bin).

    By telescoping, each probability enters with a fixed weight, so that no window
    is needed: sum over j of c_j (p_{j+1} - p_j) = sum over j of (c_{j-1} - c_j) p_j.
    """
    last = cdf.BINS - 1
    j = F.col("bin").cast("double")

    def weight(power: int) -> Column:
        def c(x: Column) -> Column:
            mid = x + F.lit(0.5)
            return mid if power == 1 else mid * mid

        left = F.when(F.col("bin") > 0, c(j - F.lit(1.0))).otherwise(F.lit(0.0))
        right = F.when(F.col("bin") < last, c(j)).otherwise(F.lit(0.0))
        return left - right

    m = long.groupBy(*keys).agg(
        F.sum(weight(1) * F.col("p")).alias("mu"), F.sum(weight(2) * F.col("p")).alias("second")
    )
    return m.select(*keys, "mu", (F.col("second") - F.col("mu") * F.col("mu")).alias("var"))


def quantile_bounds(
    df: DataFrame, keys: list[str], value: str, lo: float, hi: float, n_bins: int = 100
) -> DataFrame:
    """Intensity bounds per key from a cumulated fixed-bin histogram.

    Bins are half-open over [min, max), so the maximum itself is not counted.  The
    low bound is the first bin whose cumulated share exceeds ``lo``; the high bound
    walks down from the last bin while the share exceeds ``hi`` and then steps up
    once unless it stayed near the top.  Both scale the extremes and are truncated.
    Both aggregations combine map-side; at most ``n_bins`` rows per key remain.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    span = rows.groupBy(*keys).agg(
        F.min("v").alias("vmin"), F.max("v").alias("vmax"), F.count("*").alias("rows_in_key")
    )
    spread = F.col("vmax") - F.col("vmin")
    slot = F.floor((F.col("v") - F.col("vmin")) * F.lit(float(n_bins)) / spread).cast("int")
    binned = (
        attach_group(rows, span, keys, "rows_in_key")
        .where(F.col("v") < F.col("vmax"))
        .groupBy(*keys, slot.alias("slot"))
        .agg(F.count("*").alias("n"))
    )
    along = Window.partitionBy(*keys).orderBy("slot")
    share = binned.select(
        *keys, "slot",
        (F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0))
         / F.sum("n").over(Window.partitionBy(*keys))).alias("share"),
    )
    edge = share.groupBy(*keys).agg(
        F.min(F.when(F.col("share") > lo, F.col("slot"))).alias("first_above"),
        # The share is constant between occupied bins, so the walk down stops just
        # below the first occupied bin whose share exceeds `hi`.
        F.min(F.when(F.col("share") > hi, F.col("slot"))).alias("hi_above"),
    )
    top = n_bins - 1
    low = F.least(F.coalesce(F.col("first_above"), F.lit(top)), F.lit(top))
    stop = F.greatest(F.coalesce(F.col("hi_above") - 1, F.lit(top)), F.lit(0))
    high = F.when(stop < top - 1, stop + 1).otherwise(stop)
    return span.join(edge, keys, "left").select(
        *keys,
        "vmin", "vmax", "rows_in_key",
        (F.col("vmin") * (low / F.lit(float(n_bins)))).cast("bigint").alias("lo"),
        (F.col("vmax") * (high / F.lit(float(n_bins)))).cast("bigint").alias("hi"),
    )


def exact_percentiles(
    df: DataFrame, value: str, probs: list[float], n_bins: int = 4096
) -> DataFrame:
    """Exact linear-interpolated percentiles of a whole column, one row ``q0..qk``.

    The bins that hold a wanted rank are opened again between their own least and greatest
    value until they hold one value.  Each pass sums one narrow column into ``n_bins`` counts
    per open bin; outliers only cost a pass, and no value is ever sorted.  The driver sees
    the counts of at most ``2 * len(probs)`` open bins.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    span = rows.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("n")).first()
    spark = df.sparkSession
    if not span["n"]:
        return spark.range(1).select(*[F.lit(None).cast("double").alias(f"q{i}") for i in range(len(probs))])
    at = [(span["n"] - 1) * p for p in probs]
    ranks = sorted({r for x in at for r in (math.floor(x), math.ceil(x))})
    found: dict[int, float] = {}
    open_bins = {(span["a"], span["b"]): (0, ranks)}  # bounds -> rows before, ranks inside
    while open_bins:
        for (a, b), (_, inside) in list(open_bins.items()):
            if a == b:
                found |= {r: a for r in inside}
                del open_bins[a, b]
        if not open_bins:
            break
        bounds = list(open_bins)
        # Bins of one pass do not overlap; a value belongs to the first whose bounds hold it.
        which = F.lit(None).cast("int")
        slot = F.lit(None).cast("int")
        for i, (a, b) in reversed(list(enumerate(bounds))):
            held = F.col("v").between(a, b)
            # Halves, since the whole width can overflow.
            place = F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * n_bins).cast("int")
            which, slot = F.when(held, F.lit(i)).otherwise(which), F.when(held, F.least(place, F.lit(n_bins - 1))).otherwise(slot)
        counts = rows.select("v", which.alias("which"), slot.alias("slot")).where(F.col("which").isNotNull()).groupBy("which", "slot").agg(
            F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        after: dict[tuple[float, float], tuple[int, list[int]]] = {}
        by_bin: dict[int, list] = {}
        for r in counts.collect():
            by_bin.setdefault(r["which"], []).append((r["slot"], r["n"], r["a"], r["b"]))
        for i, got in by_bin.items():
            before, inside = open_bins[bounds[i]]
            for _, n, a, b in sorted(got):
                mine = [r for r in inside if before <= r < before + n]
                if mine:
                    after[a, b] = (before, mine)
                before += n
        open_bins = after
    low = [found[math.floor(x)] for x in at]
    high = [found[math.ceil(x)] for x in at]
    return spark.range(1).select(*[
        F.lit(float(a + (b - a) * (x - math.floor(x)))).alias(f"q{i}") for i, (a, b, x) in enumerate(zip(low, high, at))])
