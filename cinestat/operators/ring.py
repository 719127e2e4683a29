"""Cyclic sequences: one row per (key, frame), a bounded number of frames per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _along(keys: list[str], frame: str):
    return Window.partitionBy(*keys).orderBy(frame)


def _whole(keys: list[str], frame: str):
    return _along(keys, frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def previous(value: str, keys: list[str], frame: str) -> Column:
    """Value of the frame before, wrapping to the last frame."""
    return F.coalesce(F.lag(value).over(_along(keys, frame)), F.last(value).over(_whole(keys, frame)))


def following(value: str, keys: list[str], frame: str) -> Column:
    """Value of the frame after, wrapping to the first frame."""
    return F.coalesce(F.lead(value).over(_along(keys, frame)), F.first(value).over(_whole(keys, frame)))


def ring_frame(frame: Column, offset: int, n: int = 30) -> Column:
    """Frame number ``offset`` steps away on the ring 1..n."""
    return F.pmod(frame - 1 + F.lit(offset), F.lit(n)) + 1


def triplets(df: DataFrame, keys: list[str], frame: str, value: str, n: int = 30) -> DataFrame:
    """Join every frame with its ring neighbours by frame number (missing ones stay NULL)."""
    prev = df.select(*keys, ring_frame(F.col(frame), 1, n).alias(frame), F.col(value).alias("prev"))
    nxt = df.select(*keys, ring_frame(F.col(frame), -1, n).alias(frame), F.col(value).alias("next"))
    return df.join(prev, [*keys, frame], "left").join(nxt, [*keys, frame], "left")


def pad_cycle(df: DataFrame, keys: list[str], frame: str, length: int) -> DataFrame:
    """Truncate to ``length`` frames, or repeat the frames cyclically up to it.

    Every source row emits the positions it fills, so no position table is joined.
    """
    numbered = df.select(
        "*",
        F.row_number().over(_along(keys, frame)).alias("__rn"),
        F.count("*").over(Window.partitionBy(*keys)).cast("int").alias("__n"),
    ).where(F.col("__rn") <= length)
    fills = F.sequence(F.col("__rn") - 1, F.lit(length - 1), F.col("__n"))
    return numbered.select("*", F.explode(fills).alias("pos")).drop("__rn", "__n")


def as_array(df: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Frames of a key as one ordered array of ``(frame, v)``; frames per key are bounded."""
    entry = F.struct(F.col(frame).alias("frame"), F.col(value).alias("v"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("ring"))


def upper_median(values: Column) -> Column:
    """Element n/2 (0-based) of the sorted array."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def outlier_flags(values: Column) -> Column:
    """Frames to replace in a cyclic series, as an array of 0/1.

    A frame starts a run when the change to its successor is five times the change
    into it, more than 15 percent and above 2.5.  The successor is always marked; the
    run goes on while the change does not fall by 2 or the value triples the start.
    The frame that ends a run is not tested as a new start.
    """
    n = F.size(values)
    jump = F.transform(
        values, lambda v, i: F.abs(v - F.get(values, F.when(i == 0, n - 1).otherwise(i - 1)))
    )

    def state(mode: Column, start: Column, flags: Column) -> Column:
        return F.struct(mode.alias("mode"), start.alias("start"), flags.alias("flags"))

    def step(acc: Column, i: Column) -> Column:
        nxt = F.pmod(i + 1, n)
        here, there = F.get(values, i), F.get(values, nxt)
        into, out = F.get(jump, i), F.get(jump, nxt)
        opens = (
            (out > 5.0 * into)
            & ((there > 1.15 * here) | (here > 1.15 * there))
            & (out > 2.5)
            & (i < n - 1)
        )
        goes_on = (into - out < 2) | (F.coalesce(F.try_divide(here, acc["start"]), F.lit(0.0)) > 3)
        marked = (acc["mode"] == 1) | ((acc["mode"] == 2) & goes_on)
        mode = (
            F.when(acc["mode"] == 0, F.when(opens, 1).otherwise(0))
            .when(acc["mode"] == 1, 2)
            .otherwise(F.when(goes_on, 2).otherwise(0))
        )
        start = F.when((acc["mode"] == 0) & opens, here).otherwise(acc["start"])
        return state(mode, start, F.array_append(acc["flags"], marked.cast("int")))

    zero = state(F.lit(0), F.lit(0.0), F.array().cast("array<int>"))
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, step, lambda acc: acc["flags"])


def replace_outliers(df: DataFrame, keys: list[str], frame: str, value: str) -> DataFrame:
    """Series with flagged frames replaced by the upper median of their key."""
    rings = as_array(df, keys, frame, value).withColumn("vs", F.transform("ring", lambda r: r["v"]))
    flagged = rings.select(
        *keys, "ring", upper_median(F.col("vs")).alias("median"), outlier_flags(F.col("vs")).alias("flags")
    )
    entry = F.arrays_zip("ring", "flags")
    long = flagged.select(*keys, "median", F.explode(entry).alias("e"))
    bad = F.col("e.flags") == 1
    return long.select(
        *keys, F.col("e.ring.frame").alias(frame), F.col("e.ring.v").alias(value), bad.alias("bad"),
        F.when(bad, F.col("median")).otherwise(F.col("e.ring.v")).alias("filtered"),
    )


def rolling_median(df: DataFrame, keys: list[str], frame: str, value: str, half: int = 2) -> DataFrame:
    """Cyclic running median of 2*half+1 frames."""
    rings = as_array(df, keys, frame, value)
    n = F.size("ring")
    window = F.sequence(F.lit(-half), F.lit(half))

    def median(r: Column, i: Column) -> Column:
        around = F.transform(window, lambda d: F.get("ring", F.pmod(i + d, n))["v"])
        return F.struct(r["frame"].alias(frame), F.get(F.array_sort(around), half).alias("smooth"))

    return rings.select(*keys, F.inline(F.transform("ring", median)))


def smoothed_totals(df: DataFrame, frame: str, value: str) -> DataFrame:
    """Sum per frame over all keys, smoothed by (1/4, 1/2, 1/4) with mirrored ends."""
    totals = df.groupBy(frame).agg(F.sum(value).alias("total"))
    w = Window.orderBy(frame)  # one row per frame of the ring
    before = F.coalesce(F.lag("total").over(w), F.lead("total").over(w))
    after = F.coalesce(F.lead("total").over(w), F.lag("total").over(w))
    return totals.select(frame, "total", (0.25 * before + 0.5 * F.col("total") + 0.25 * after).alias("smooth"))


def smoothed_grid(df: DataFrame, keys: list[str], row: str, frame: str, value: str, out: str = "smooth") -> DataFrame:
    """``value`` of a (row, frame) grid per key under (1/4, 1/2, 1/4) both ways.

    Frames are cyclic, rows are mirrored at both ends (the first row's neighbour above is the
    second); a single row or frame stays as it is.  Along frames rows are placed by key and
    row, along rows by key and frame: no placement gathers a whole grid.  Neighbours are by
    order, so missing frames and rows close up.
    """
    around = 0.25 * previous(value, [*keys, row], frame) + 0.5 * F.col(value) + 0.25 * following(value, [*keys, row], frame)
    cyclic = df.withColumn("__c", around)
    w = Window.partitionBy(*keys, frame).orderBy(row)
    above, below = F.lag("__c").over(w), F.lead("__c").over(w)
    mirrored = 0.25 * F.coalesce(above, below, "__c") + 0.5 * F.col("__c") + 0.25 * F.coalesce(below, above, "__c")
    return cyclic.withColumn(out, mirrored).drop("__c")
