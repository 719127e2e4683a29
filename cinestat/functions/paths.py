"""Path parsing: keys of a study live in its file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def split_any(text: Column, delimiters: str) -> Column:
    """Split on any of several characters."""
    chars = "".join("\\" + c for c in delimiters)
    return F.split(text, f"[{chars}]")


def frame_number(path: Column) -> Column:
    """Third part of a stem with three or four parts; anything else is an error."""
    parts = F.split(stem(path), "-")
    bad = F.raise_error(F.concat(F.lit("unexpected frame file name: "), path))
    return F.when(F.size(parts).isin(3, 4), F.get(parts, 2).try_cast("int")).otherwise(bad.cast("int"))


def patient_id(path: Column) -> Column:
    """Component before ``study``; -1 when it is not a number."""
    text = F.regexp_extract(path, r"([^/]+)/study/", 1)
    return F.coalesce(text.try_cast("int"), F.lit(-1))


def sequence_type(dir_: Column) -> Column:
    return F.when(
        F.regexp_extract(dir_, r"(?:^|/)(sax|2ch|4ch)_\d+$", 1) != "",
        F.regexp_extract(dir_, r"(?:^|/)(sax|2ch|4ch)_\d+$", 1),
    )


def sequence_number(dir_: Column) -> Column:
    return F.regexp_extract(dir_, r"_(\d+)$", 1).try_cast("int")


def add_suffix(path: Column, suffix: str, delimiter: str = "_") -> Column:
    """Insert a suffix before the extension."""
    return F.regexp_replace(path, r"(\.[^./]*)$", f"{delimiter}{suffix}$1")


def strip_prefix(path: Column, prefix: Column) -> Column:
    return F.substring(path, F.length(prefix) + 2, F.length(path))
