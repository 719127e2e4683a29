"""Submission tables: one row per id of a template, 600 probabilities each."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cinestat.functions import cdf
from cinestat.session import spread

COLUMNS = ["Id", *[f"P{i}" for i in range(cdf.BINS)]]


def to_arrays(long: DataFrame, keys: list[str]) -> DataFrame:
    """Long bins to one ordered array per key (BINS entries, hence bounded)."""
    entry = F.struct("bin", "p")
    return long.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["p"]).alias("p")
    )


def fill_template(template: DataFrame, own: DataFrame, fallback: DataFrame) -> DataFrame:
    """Left join of the template with predictions; misses take the fallback of their target.

    ``template(study, target)``, ``own(study, target, p)``, ``fallback(target, p)``, with one
    array per key (``to_arrays`` makes them of long bins).  The fallback has one row per
    target and is read as a scalar map.  Values are rounded by the writer only.
    """
    default = fallback.agg(F.map_from_entries(F.collect_list(F.struct("target", "p"))).alias("m")).scalar()
    # Ids are narrow, but each becomes 600 values.
    joined = spread(template, "study", "target").join(own, ["study", "target"], "left")
    return joined.select(
        F.concat_ws("_", F.col("study").cast("string"), "target").alias("id"),
        "study", "target", F.col("p").isNull().alias("missed"),
        F.coalesce("p", F.try_element_at(default, F.col("target"))).alias("p"),
    )


def gaussian_rows(volumes: DataFrame, sigma: float) -> DataFrame:
    """Rows from ``(study, is_diastole, volume)`` with one common spread."""
    target = F.when(F.col("is_diastole") == 0, "Systole").otherwise("Diastole")
    return volumes.select(
        F.concat_ws("_", F.col("study").cast("string"), target).alias("id"),
        cdf.norm_array(F.col("volume"), F.lit(sigma)).alias("p"),
    )


def write_submission(rows: DataFrame, path: str) -> None:
    """CSV with the 600 columns; the array is widened only here."""
    wide = rows.select(
        F.col("id").alias("Id"),
        *[F.format_string("%.5f", F.get("p", i)).alias(f"P{i}") for i in range(cdf.BINS)],
    )
    wide.write.mode("overwrite").option("header", True).csv(path)


def read_submission(spark, path: str) -> DataFrame:
    """CSV back to ``(id, study, target, p)``."""
    schema = ", ".join(["Id string", *[f"P{i} double" for i in range(cdf.BINS)]])
    wide = spark.read.schema(schema).option("header", True).csv(path)
    return wide.select(
        F.col("Id").alias("id"),
        F.split_part("Id", F.lit("_"), F.lit(1)).try_cast("bigint").alias("study"),
        F.split_part("Id", F.lit("_"), F.lit(2)).alias("target"),
        F.array(*[f"P{i}" for i in range(cdf.BINS)]).alias("p"),
    )
