"""Headerless and wide CSV tables, with schemas given by code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Column names of the feature file, in file order.
FEATURES = [
    "patient", "is_man", "is_adult", "age_y", "is_aged_y", "is_aged_m", "is_aged_w", "is_aged_d",
    "v_min", "v_max", "v_min_cpr", "v_max_cpr", "h_lv", "sax_count", "sax_waste_count",
    "time_sys_dias", "time_sys_dias_cpr", "min_area_sys", "avr_area_sys", "max_area_sys",
    "min_area_dias", "avr_area_dias", "max_area_dias", "min_area_sys_cpr", "avr_area_sys_cpr",
    "max_area_sys_cpr", "min_area_dias_cpr", "avr_area_dias_cpr", "max_area_dias_cpr",
]


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """29 numeric columns without header; a malformed row fails the read."""
    schema = ", ".join(f"{c} double" for c in FEATURES)
    return spark.read.schema(schema).option("mode", "FAILFAST").csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``Id, Systole, Diastole`` with header, addressed by name."""
    named = spark.read.option("header", True).csv(path)
    return named.select(
        F.col("Id").try_cast("int").alias("study_id"), F.col("Systole").try_cast("double").alias("systole"),
        F.col("Diastole").try_cast("double").alias("diastole"),
    )


def read_arrays(spark: SparkSession, path: str, length: int) -> DataFrame:
    """One array per line of comma-separated numbers; the length is checked.

    Meant for rows too wide for columns, such as 30 x 128 x 128 pixels.
    """
    values = F.transform(F.split("value", ","), lambda v: v.try_cast("double"))
    rows = spark.read.text(path).select(values.alias("px"))
    bad = F.raise_error(F.concat(F.lit("unexpected row length "), F.size("px").cast("string")))
    return rows.select(F.when(F.size("px") == length, F.col("px")).otherwise(bad.cast("array<double>")).alias("px"))


def write_arrays(df: DataFrame, path: str, px: str = "px", key: str | None = None) -> None:
    """One line per array, optionally led by its key."""
    text = F.array_join(F.transform(px, lambda v: v.cast("string")), ",")
    line = F.concat_ws(",", F.col(key).cast("string"), text) if key else text
    df.select(line.alias("value")).write.mode("overwrite").text(path)


def write_split(df: DataFrame, path: str, split: str) -> None:
    """Parquet partitioned by the split column (train / validate)."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Add rows to a metrics table."""
    metrics.write.mode("append").parquet(path)
