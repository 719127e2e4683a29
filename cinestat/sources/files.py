"""File listings and plain images."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cinestat.functions import paths
from cinestat.operators.keyed import complete_keys


def list_files(spark: SparkSession, root: str, extension: str, *, recursive: bool = True, name: str | None = None) -> DataFrame:
    """``path, size, modified`` of files; the contents are not read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", f"*{extension}").load(root)
    )
    out = files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return out.where(paths.basename(F.col("path")).rlike(f"^(?:{name})$")) if name else out


def list_directories(files: DataFrame) -> DataFrame:
    """Directories with their file counts."""
    return files.groupBy(paths.directory(F.col("path")).alias("dir")).agg(F.count("*").alias("files"))


def complete_directories(files: DataFrame, kind: str = "sax", n: int = 30) -> DataFrame:
    """Directories of a kind that hold every frame 1..n, with their frames in order."""
    path = F.col("path")
    chosen = files.where(path.contains(kind) & F.endswith(path, F.lit(".dcm"))).select(
        "path", paths.directory(path).alias("dir"), paths.frame_number(path).alias("frame")
    )
    whole = complete_keys(chosen, ["dir"], F.col("frame"), n)
    kept = chosen.where(F.col("frame").between(1, n)).join(whole, "dir", "left_semi")
    return kept.orderBy("dir", "frame")


# Fixed values of the PNG format: samples per pixel by colour type.
PNG_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and grey values (0..255) of a non-interlaced PNG of 8 or 16 bits, or with a palette."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, body, head, palette = 8, b"", None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body += chunk
        at += 12 + size
    if head is None or head[2] not in (8, 16) or head[3] not in PNG_SAMPLES or head[6] or (head[3] == 3 and palette is None):
        raise ValueError("unsupported PNG variant")
    w, h, n = head[0], head[1], PNG_SAMPLES[head[3]] * (head[2] // 8)
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.int64)  # one row and column of zeros before the image
    for y in range(h):
        mode, raw = lines[y, 0], lines[y, 1:].reshape(w, n).astype(np.int64)
        if mode == 0:
            out[y + 1, 1:] = raw
        elif mode == 2:
            out[y + 1, 1:] = (raw + out[y, 1:]) & 255
        elif mode == 1:
            out[y + 1, 1:] = np.cumsum(raw, axis=0) & 255
        else:
            for x in range(w):
                a, b, c = out[y + 1, x], out[y, x + 1], out[y, x]
                near = np.stack([np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)]).argmin(0)
                guess = (a + b) // 2 if mode == 3 else np.choose(near, [a, b, c])
                out[y + 1, x + 1] = (raw[x] + guess) & 255
    img = out[1:, 1:].astype(float)
    if head[2] == 16:
        img = (img[..., 0::2] * 256 + img[..., 1::2]) / 257
    elif head[3] == 3:
        img = palette[out[1:, 1:, 0]].astype(float)
    n = img.shape[-1]
    # Luma weights of red, green and blue.
    grey = img[..., :3] @ np.array([0.299, 0.587, 0.114]) if n >= 3 else img[..., 0]
    return w, h, grey.ravel()


def read_png(spark: SparkSession, root: str) -> DataFrame:
    """``path, width, height, px, error``; an image that cannot be decoded gives a row with ``error`` alone."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.png").load(root).select("path", "content")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows.append((path, *decode_png(content), None))
                except (ValueError, zlib.error, struct.error, IndexError) as exc:
                    rows.append((path, None, None, None, str(exc)))
            out = pd.DataFrame(rows, columns=["path", "width", "height", "px", "error"])
            yield out.astype({"width": "Int32", "height": "Int32"})

    return files.mapInPandas(run, "path string, width int, height int, px array<double>, error string")


def has_tag(elements: Column, tag: str) -> Column:
    return F.coalesce(F.map_contains_key(elements, tag), F.lit(False))


def tag_text(elements: Column, tag: str) -> Column:
    return F.try_element_at(elements, F.lit(tag))["text"]


def tag_numbers(elements: Column, tag: str) -> Column:
    return F.try_element_at(elements, F.lit(tag))["nums"]
