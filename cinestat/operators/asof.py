"""As-of joins: the row in force at a time, also where one key or all rows are one group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

MOST_RANGES = 10_000


def _ranges(df: DataFrame, at: str, n: int, per_range: int) -> Column | None:
    """Number of the range of time that ``at`` lies in, or None if one will do.

    Bounds come from approximate percentiles; they need not be even for the join to be right.
    """
    k = min(MOST_RANGES, math.ceil(n / per_range))
    if k <= 1:
        return None
    cuts = df.agg(F.percentile_approx(at, [i / k for i in range(1, k)], 10 * k).alias("c")).first()["c"] or []
    bounds = F.lit(sorted(set(cuts)))
    # How many cuts lie at or before it, by halving an interval of their positions: logarithmic in their number.
    steps = F.array(*[F.lit(2**i) for i in reversed(range(max(1, len(set(cuts))).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda lo, s: F.when(
        F.coalesce(F.get(bounds, lo + s - 1) <= F.col(at), F.lit(False)), lo + s).otherwise(lo))


def _split(laid: DataFrame, cell: list[str], per_range: int) -> DataFrame:
    """Adds ``__salt``: left rows of crowded cells are dealt by place, right rows come with every salt."""
    # Fewer rows than the table has pieces of 2 * per_range.
    crowded = laid.where("__side = 1").groupBy(*cell).agg(F.count("*").alias("__n")).where(F.col("__n") > 2 * per_range)
    parts = crowded.select(*[F.col(c).alias(f"{c}c") for c in cell], F.ceil(F.col("__n") / per_range).cast("int").alias("__parts"))
    same = F.lit(True)
    for c in cell:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}c"))
    met = laid.withColumn("__place", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(parts), same, "left")
    salts = F.coalesce("__parts", F.lit(1))
    dealt = F.when(F.col("__side") == 1, F.array(F.pmod("__place", salts).cast("int"))).otherwise(F.sequence(F.lit(0), salts - 1))
    return met.withColumn("__salt", F.explode(dealt)).drop("__place", "__parts", *[f"{c}c" for c in cell])


def asof_join(
    left: DataFrame, right: DataFrame, at: str, start: str, values: list[str], by: list[str] | None = None,
    per_range: int = 1_000_000,
) -> DataFrame:
    """``left`` with ``values`` of the row of ``right`` in force: the last with ``start <= at`` (and equal ``by``).

    Rows before the first start, and rows whose time is null, get nulls.  Of several rows of
    ``right`` with one start the greatest (by ``values``, in their order) counts; rows without a
    start never count.  Null keys match null keys.  Repeated left rows stay.

    Both sides are laid on one another and dealt by key and range of time, so that a task
    holds one range at most, whatever the keys.  A key's range that still has over twice
    ``per_range`` left rows (one moment may have many) is split further by place; each part
    gets the range's right rows.  Inside a part the last non-null row is carried forward.
    What was in force when a range began comes from a table with one row per key and range.
    """
    by = by or []
    seconds = right.groupBy(*by, F.col(start).alias(start)).agg(F.max(F.struct(*values)).alias("__now")).where(F.col(start).isNotNull())
    lefts = left.select(
        *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"))
    rights = seconds.select(
        *[F.col(b).alias(f"__by{i}") for i, b in enumerate(by)], F.col(start).alias("__at"), F.lit(0).alias("__side"), "__now")
    keys = [f"__by{i}" for i in range(len(by))]
    laid = lefts.unionByName(rights, allowMissingColumns=True)
    n = left.count()
    of = _ranges(lefts.select("__at"), "__at", n, per_range)
    laid = laid.withColumn("__range", F.lit(0) if of is None else of)
    placed = _split(laid, [*keys, "__range"], per_range) if n > 2 * per_range else laid.withColumn("__salt", F.lit(0))
    order = Window.partitionBy(*keys, "__range", "__salt").orderBy(F.asc_nulls_first("__at"), "__side")
    carried = placed.withColumn("__held", F.last("__now", ignorenulls=True).over(order)).where("__side = 1")
    if of is not None:
        # One row for each key and range that begins something or asks: keys times MOST_RANGES at most.
        met = laid.groupBy(*keys, "__range").agg(F.max_by("__now", F.when(F.col("__side") == 0, F.col("__at"))).alias("__end"))
        before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        begun = met.select(*[F.col(k).alias(f"{k}b") for k in keys], F.col("__range").alias("__rangeb"), F.last("__end", ignorenulls=True).over(before).alias("__begun"))
        same = F.col("__range") == F.col("__rangeb")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}b"))
        carried = carried.join(begun, same, "left").withColumn("__held", F.coalesce("__held", "__begun"))
    known = F.when(F.col("__at").isNotNull(), F.col("__held"))
    names = [c for c in left.columns if c not in values]
    return carried.select(*[F.col("__row")[c].alias(c) for c in names], *[known[v].alias(v) for v in values])
