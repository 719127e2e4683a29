"""Global ranks, seeded shuffles and splits that stay deterministic and distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cinestat.operators.keyed import attach_group
from cinestat.session import kept


def global_row_number(df: DataFrame, order: list[str], out: str = "rn") -> DataFrame:
    """1-based rank over the whole table without a single-task window.

    Range partitions are ordered among each other, so a rank is the position inside
    the partition plus the sizes of the partitions before it.  The placed rows are
    written first: partition numbers must not move between the two reads.
    """
    placed = (
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = kept(placed)
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: both this window and the broadcast are bounded by that.
    offsets = placed.groupBy(part).agg(F.count("*").alias("n")).select(
        "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before")
    )
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__part", F.shiftright("__at", 33))
        .join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__before") + inside + 1)
        .drop("__at", "__part", "__before")
    )


def seeded_key(seed: int, *cols: str) -> Column:
    """Engine-neutral pseudo-random order key (hexadecimal text)."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def seeded_below(seed: int, share: float, *cols: str) -> Column:
    """True for about ``share`` of the keys; equal keys always agree."""
    limit = f"{min(int(share * 2**32), 2**32 - 1):08x}"
    return F.substring(seeded_key(seed, *cols), 1, 8) < F.lit(limit)


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Seeded permutation: adds ``rn``, the position in the shuffled order."""
    return global_row_number(df.withColumn("__h", seeded_key(seed, key)), ["__h", key]).drop("__h")


def minibatches(df: DataFrame, seed: int, key: str, size: int = 64) -> DataFrame:
    """Shuffled batches of ``size``; as in the original loop the last one is dropped."""
    ranked = shuffled(df, seed, key)
    n = df.agg(F.count("*").alias("n")).scalar()
    batches = F.ceil(n / F.lit(size)) - 1
    batch = F.floor((F.col("rn") - 1) / F.lit(size))
    return ranked.withColumn("batch", batch).where(F.col("batch") < batches)


def group_folds(df: DataFrame, key: str, k: int = 10, out: str = "fold") -> DataFrame:
    """All rows of a key share a fold; keys are dealt round-robin in key order."""
    keys = df.groupBy(key).agg(F.count("*").alias("rows_in_key"))
    ranked = global_row_number(keys, [key]).withColumn(out, F.pmod(F.col("rn") - 1, F.lit(k)).cast("int"))
    return attach_group(df, ranked.drop("rn"), [key], "rows_in_key")


def group_split(df: DataFrame, key: str, share: float, seed: int, out: str = "is_test") -> DataFrame:
    """Exact share of the keys (rounded down) goes to the test side."""
    keys = df.groupBy(key).agg(F.count("*").alias("rows_in_key"))
    ranked = shuffled(keys, seed, key)
    n = keys.agg(F.count("*").alias("n")).scalar()
    marked = ranked.withColumn(out, F.col("rn") <= F.floor(n * F.lit(share))).drop("rn")
    return attach_group(df, marked, [key], "rows_in_key")
