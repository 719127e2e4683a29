"""Readers and writers of the line-oriented side files.

Lines are ragged, so they are read as text and split by column expressions.  Where the
last line of a key wins, lines are ordered by file, block offset and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinestat.operators.ranking import global_row_number
from cinestat.functions import paths, shapes
from cinestat.operators.keyed import latest_per_key


def _lines(spark: SparkSession, path: str, splitter: str = r"\s+") -> DataFrame:
    """Tokens of every non-empty line and an order key that follows the file."""
    text = spark.read.text(path)
    line = F.struct(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )
    clean = F.trim(F.regexp_replace("value", r"[\t\r\n]+$", ""))
    rows = text.select(line.alias("line"), clean.alias("value")).where(F.col("value") != "")
    return rows.select("line", F.split("value", splitter).alias("t"))


def _number(tokens: Column, i: int, kind: str = "double") -> Column:
    return F.get(tokens, i).try_cast(kind)


def _doubles(tokens: Column) -> Column:
    return F.transform(tokens, lambda v: v.try_cast("double"))


def _points_from(tokens: Column, start: int) -> Column:
    """Pairs of numbers from position ``start``; reading stops at an incomplete pair."""
    return shapes.points(_doubles(F.slice(tokens, start + 1, F.greatest(F.size(tokens) - start, F.lit(0)))))


def _last(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return latest_per_key(rows, [F.col(key).alias("__k")], [F.col("line")], columns)


def read_centres(spark: SparkSession, path: str) -> DataFrame:
    """``file x y``: estimated centre per base name without extension."""
    t = F.col("t")
    rows = _lines(spark, path).select(
        "line", paths.stem(F.get(t, 0)).alias("image"), _number(t, 1, "int").alias("x"), _number(t, 2, "int").alias("y")
    )
    return _last(rows, "image", ["image", "x", "y"])


def read_landmarks(spark: SparkSession, path: str) -> DataFrame:
    """``name x y x y ...``: points per image."""
    rows = _lines(spark, path).select("line", F.get("t", 0).alias("image"), _points_from(F.col("t"), 1).alias("pts"))
    return _last(rows, "image", ["image", "pts"])


def read_contours(spark: SparkSession, path: str) -> DataFrame:
    """``name rect(4) x y ...`` separated by tabs."""
    t = F.col("t")
    rect = F.struct(*[_number(t, i + 1).alias(n) for i, n in enumerate(("x", "y", "w", "h"))])
    return _lines(spark, path, "\t").select(F.get(t, 0).alias("image"), rect.alias("rect"), _points_from(t, 5).alias("pts"))


def read_training_shapes(spark: SparkSession, path: str, landmarks: int) -> DataFrame:
    """``name box(4)`` and exactly ``landmarks`` points; other lines are an error."""
    t = F.col("t")
    start_x, start_y, w, h = (_number(t, i) for i in range(1, 5))
    box = F.struct(
        start_x.alias("start_x"), start_y.alias("start_y"), w.alias("width"), h.alias("height"),
        (start_x + w / 2).alias("centroid_x"), (start_y + h / 2).alias("centroid_y"),
    )
    checked = F.when(F.size(t) == 5 + 2 * landmarks, F.get(t, 0)).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of landmarks: "), F.get(t, 0))).cast("string")
    )
    return _lines(spark, path).select(checked.alias("image"), box.alias("box"), _points_from(t, 5).alias("pts"))


def read_boxes(spark: SparkSession, path: str, name: str = r".*\.csv") -> DataFrame:
    """``path x y w h`` separated by commas or blanks, from files whose name matches."""
    t = F.col("t")
    rows = _lines(spark, path, r"[, \n]+").where(paths.basename(F.col("line.f")).rlike(f"^(?:{name})$"))
    return rows.select(F.get(t, 0).alias("path"), *[_number(t, i + 1, "int").alias(c) for i, c in enumerate("xywh")])


def read_frame_range(spark: SparkSession, path: str) -> DataFrame:
    """``patient min max``: the first line of a patient counts."""
    t = F.col("t")
    rows = _lines(spark, path).select(
        "line", *[_number(t, i, "int").alias(c) for i, c in enumerate(("patient_id", "min_frame", "max_frame"))]
    )
    first = rows.groupBy("patient_id").agg(F.min_by(F.struct("min_frame", "max_frame"), "line").alias("r"))
    return first.select("patient_id", "r.*")


def frame_range(patients: DataFrame, ranges: DataFrame | None) -> DataFrame:
    """Range per patient; the default (12, 0) applies only when there is no file at all."""
    if ranges is None:
        return patients.select("*", F.lit(12).alias("min_frame"), F.lit(0).alias("max_frame"))
    return patients.join(ranges, "patient_id", "left")


def read_areas(spark: SparkSession, path: str) -> DataFrame:
    """``sequence area_0 area_1 ...``; the first token lists the usable sequences."""
    t = F.col("t")
    return _lines(spark, path).select(F.get(t, 0).alias("sequence"), _doubles(F.slice(t, 2, F.size(t))).alias("areas"))


def read_parameter(spark: SparkSession, path: str, line: int) -> Column:
    """Number on the given line of a small text file, as a scalar column."""
    rows = _lines(spark, path).select("line", _number(F.col("t"), 0).alias("v"))
    return global_row_number(rows, ["line"]).where(F.col("rn") == line + 1).select("v").scalar()


def _tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def write_landmarks(shapes_: DataFrame, path: str, *, space: bool = False) -> None:
    """``sequence frame x y [z]``, one line per landmark of ``(sequence, frame, pts)``."""
    long = shapes_.select("sequence", "frame", F.posexplode("pts").alias("pos", "p"))
    cols = ["p.x", "p.y", *(["p.z"] if space else [])]
    ordered = long.sort("sequence", "frame", "pos")
    _tsv(ordered.select("sequence", "frame", *cols), path)


def write_areas(areas: DataFrame, path: str, frames: int = 30) -> None:
    """One line per sequence, one column per frame of ``(sequence, frame, area)``."""
    wide = areas.groupBy("sequence").pivot("frame", list(range(1, frames + 1))).agg(F.first("area"))
    _tsv(wide, path)


def write_ragged(rows: DataFrame, path: str, head: list[str], pts: str) -> None:
    """Leading columns and then all coordinates of a point array, tab separated.

    Rows whose points are missing are skipped.
    """
    flat = F.flatten(F.transform(pts, lambda p: F.array(p["x"], p["y"])))
    tail = F.array_join(F.transform(flat, lambda v: v.cast("string")), "\t")
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in head], tail)
    rows.where(F.col(pts).isNotNull()).select(line.alias("value")).write.mode("overwrite").text(path)
