"""Keyed relational operators: attach, de-duplicate, filter by group, fall back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cinestat.session import kept

HOT_ROWS = 5_000_000


def attach_group(
    df: DataFrame, stats: DataFrame, keys: list[str], n: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Inner join of rows with one aggregate row per key, safe for very large keys.

    ``stats`` carries the row count of its key in ``n``.  A count by key comes first; Catalyst
    prunes all other aggregates from it.  Keys above ``hot_rows`` rows are at most
    total/hot_rows many, which bounds the broadcast list of them; their rows are salted by
    place, whatever they hold, so that no task receives more than about ``hot_rows`` of them.
    Without such a key nothing is written and the join is a plain one.
    """
    salts = F.ceil(F.col(n) / F.lit(hot_rows)).cast("int")
    parts = "__salts"
    if stats.where(F.col(n) > hot_rows).select(n).isEmpty():
        return df.join(stats.drop(n), keys)
    stats = kept(stats)
    hot = stats.where(F.col(n) > hot_rows).select(*keys, salts.alias(parts))
    place = F.xxhash64(F.monotonically_increasing_id())
    left = df.withColumn("__place", place).join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.pmod(F.col("__place"), F.coalesce(F.col(parts), F.lit(1))).cast("int")).drop(parts, "__place")
    right = stats.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))
    ).drop(n)
    return left.join(right, [*keys, "__salt"]).drop("__salt")


def latest_per_key(df: DataFrame, keys: list[Column], order: list[Column], columns: list[str]) -> DataFrame:
    """Row with the greatest ``order`` per key; one hash aggregation, no per-key sort."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("best")
    return df.groupBy(*keys).agg(best).select("best.*")


def modal_rows(
    df: DataFrame, keys: list[str], value: Column, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keep rows whose value is the most frequent of their key (ties: the smallest)."""
    tagged = df.withColumn("__v", value)
    counts = tagged.groupBy(*keys, "__v").agg(F.count("*").alias("n"))
    modes = counts.groupBy(*keys).agg(
        F.min_by("__v", F.struct(-F.col("n"), F.col("__v"))).alias("modal"),
        F.sum("n").alias("rows_in_key"),
    )
    both = attach_group(tagged, modes, keys, "rows_in_key", hot_rows)
    return both.where(F.col("__v") == F.col("modal")).drop("__v")


def complete_keys(df: DataFrame, keys: list[str], frame: Column, n: int) -> DataFrame:
    """Keys that own every frame 1..n; frames outside that range are ignored."""
    inside = df.select(*keys, frame.alias("frame")).where(F.col("frame").between(1, n)).distinct()
    return inside.groupBy(*keys).agg(F.count("*").alias("frames")).where(F.col("frames") == n).select(*keys)


def sized_keys(df: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """Keys with lo..hi rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n").between(lo, hi))


def with_fallback(left: DataFrame, right: DataFrame, key: str, values: list[str], default: DataFrame) -> DataFrame:
    """Left join; misses take the values of the one-row ``default`` and are marked."""
    hit = right.select(key, F.struct(*values).alias("__hit"))
    joined = left.join(hit, key, "left")
    one = default.select(F.struct(*values).alias("d")).scalar()
    miss = F.col("__hit").isNull()
    return joined.select(
        *left.columns,
        miss.alias("missed"),
        *[F.when(miss, one[v]).otherwise(F.col("__hit")[v]).alias(v) for v in values],
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def step_lookup(df: DataFrame, at: str, schedule: dict[int, float], out: str) -> DataFrame:
    """Value of a step schedule in force at ``at``; the schedule is a small literal."""
    col = F.lit(None).cast("double")
    for start in sorted(schedule):
        col = F.when(F.col(at) >= start, F.lit(schedule[start])).otherwise(col)
    return df.withColumn(out, col)
