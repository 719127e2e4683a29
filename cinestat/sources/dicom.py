"""DICOM frames as a DataFrame.

Spark lists and splits the files (``binaryFile``); a task decodes an Arrow batch of
them.  Keys come from the path as column expressions, so that filters on patient or
sequence prune files before any byte is decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from cinestat.functions import paths

# Fixed values of the file format: value types, and the types of the tags that are
# used when the transfer syntax leaves them implicit.
TEXT_VR = {"AE", "AS", "CS", "DA", "DS", "DT", "IS", "LO", "LT", "PN", "SH", "ST", "TM", "UC", "UI", "UR", "UT"}
LONG_VR = {"OB", "OD", "OF", "OL", "OV", "OW", "SQ", "SV", "UC", "UN", "UR", "UT", "UV"}
NUMBER_VR = {
    "SS": "i2", "SL": "i4", "US": "u2", "AT": "u2", "OW": "u2", "UL": "u4",
    "FL": "f4", "OF": "f4", "FD": "f8", "OB": "i1", "UN": "i1", "OD": "f8", "OL": "u4", "OV": "u8", "SV": "i8", "UV": "u8",
}
TAGS = {
    "series_time": ("0008,0031", "TM"), "slice_thickness": ("0018,0050", "DS"),
    "position": ("0020,0032", "DS"), "orientation": ("0020,0037", "DS"),
    "slice_location": ("0020,1041", "DS"), "photometric": ("0028,0004", "CS"),
    "rows": ("0028,0010", "US"), "cols": ("0028,0011", "US"),
    "pixel_spacing": ("0028,0030", "DS"), "bits_allocated": ("0028,0100", "US"),
    "bits_stored": ("0028,0101", "US"), "high_bit": ("0028,0102", "US"),
    "signed": ("0028,0103", "US"), "largest": ("0028,0107", "US"),
    "intercept": ("0028,1052", "DS"), "slope": ("0028,1053", "DS"),
    "pixels": ("7fe0,0010", "OW"),
}
IMPLICIT_VR = dict(TAGS.values())
SEQUENCE_END = bytes.fromhex("fffee0dd00000000")
BIG, DEFLATED, EXPLICIT, IMPLICIT = (
    "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2",
)

FRAME_TYPES = {
    "path": "string", "rows": "int", "cols": "int", "px": "array<double>", "row_dc": "array<double>",
    "col_dc": "array<double>", "position": "array<double>", "pixel_spacing": "array<double>",
    "slice_location": "double", "slice_thickness": "double", "acquisition_time": "double", "largest": "double",
    "elements": "map<string,struct<vr:string,text:string,nums:array<double>>>", "error": "string",
}


def elements(data: bytes) -> dict[str, tuple[str, str, bytes]]:
    """All elements as tag -> (value type, byte order, raw bytes); truncation ends the walk."""
    if data[128:132] != b"DICM":
        raise ValueError("not DICOM format")
    out: dict[str, tuple[str, str, bytes]] = {}
    at, order, explicit, meta = 132, "<", True, True
    while at + 8 <= len(data):
        if meta and struct.unpack_from("<H", data, at)[0] != 2:
            meta = False
            syntax = out.get("0002,0010", ("", "", b""))[2].decode("ascii", "ignore")
            if BIG in syntax:
                order = ">"
            elif DEFLATED in syntax:
                raise ValueError("deflated transfer syntax is not supported")
            elif IMPLICIT in syntax and EXPLICIT not in syntax:
                explicit = False
        group, element = struct.unpack_from(order + "HH", data, at)
        tag, at = f"{group:04x},{element:04x}", at + 4
        if explicit:
            vr = data[at : at + 2].decode("latin-1")
            if not (vr.isascii() and vr.isalpha() and vr.isupper()):
                raise ValueError(f"no value type at {tag}")
            if vr not in TEXT_VR and vr not in NUMBER_VR and vr != "SQ":
                vr = "UN"  # types to come have the long form and are skipped by their length
            wide = vr in LONG_VR
            if at + (8 if wide else 4) > len(data):
                break
            size = struct.unpack_from(order + ("I" if wide else "H"), data, at + (4 if wide else 2))[0]
            at += 8 if wide else 4
        else:
            vr = IMPLICIT_VR.get(tag, "UN")
            if at + 4 > len(data):
                break
            size = struct.unpack_from(order + "I", data, at)[0]
            at += 4
        if size == 0xFFFFFFFF:
            end = data.find(SEQUENCE_END, at)
            if end < 0:
                break
            out[tag], at = ("SQ", order, data[at:end]), end + len(SEQUENCE_END)
            continue
        if at + size > len(data):
            break
        out[tag], at = (vr, order, data[at : at + size]), at + size
    return out


def _numbers(el: dict, name: str) -> list[float] | None:
    """Values of a named tag; numeric text is split at backslashes, anything else is missing."""
    vr, order, raw = el.get(TAGS[name][0], (None, None, b""))
    if vr is None:
        return None
    if vr in TEXT_VR:
        try:
            return [float(t) for t in raw.decode("latin-1").strip(" \0").split("\\")]
        except ValueError:
            return None
    kind = NUMBER_VR[vr]
    return np.frombuffer(raw, order + kind, len(raw) // int(kind[1])).astype(float).tolist()


def _required(el: dict, name: str) -> int:
    values = _numbers(el, name)
    if not values:
        raise ValueError(f"missing tag {TAGS[name][0]} ({name})")
    return int(values[0])


def decode(data: bytes, pixels: bool = True, all_elements: bool = False) -> dict:
    """One file to a record; raises ``ValueError`` for what the format reader rejects."""
    el = elements(data)
    if TAGS["photometric"][0] not in el:
        raise ValueError("missing tag 0028,0004 (photometric)")
    if b"MONOCHROME2" not in el[TAGS["photometric"][0]][2]:
        raise ValueError("unsupported photometric interpretation")
    signed, bits = _required(el, "signed") != 0, _required(el, "bits_allocated")
    rows, cols = _required(el, "rows"), _required(el, "cols")
    axes = _numbers(el, "orientation") or []

    def one(name: str) -> float | None:
        values = _numbers(el, name)
        return values[0] if values else None

    def several(name: str, n: int) -> list[float] | None:
        values = _numbers(el, name)
        return values[:n] if values and len(values) >= n else None

    record = {
        "rows": rows, "cols": cols, "px": None,
        "row_dc": axes[:3] if len(axes) >= 6 else None, "col_dc": axes[3:6] if len(axes) >= 6 else None,
        "position": several("position", 3), "pixel_spacing": several("pixel_spacing", 2),
        "slice_location": one("slice_location"), "slice_thickness": one("slice_thickness"),
        "acquisition_time": one("series_time"), "largest": one("largest"),
    }
    if all_elements:
        record["elements"] = {tag: _element(v) for tag, v in el.items() if tag != TAGS["pixels"][0]}
    if pixels:
        record["px"] = _pixels(el, rows * cols, bits, signed)
    return record


def _element(value: tuple[str, str, bytes]) -> dict:
    vr, order, raw = value
    if vr in TEXT_VR:
        return {"vr": vr, "text": raw.decode("latin-1").rstrip(" \0"), "nums": None}
    kind = NUMBER_VR.get(vr, "u1")
    return {"vr": vr, "text": None, "nums": np.frombuffer(raw, order + kind, len(raw) // int(kind[1])).astype(float).tolist()}


def _pixels(el: dict, n: int, bits: int, signed: bool) -> np.ndarray:
    """Decoded, unpadded and rescaled pixel values."""
    if bits not in (8, 16):
        raise ValueError(f"unsupported bit allocation {bits}")
    if TAGS["pixels"][0] not in el:
        raise ValueError("missing tag 7fe0,0010 (pixels)")
    _, order, raw = el[TAGS["pixels"][0]]
    kind = f"{order}{'i' if signed else 'u'}{bits // 8}"
    if len(raw) < n * (bits // 8):
        raise ValueError("pixel data is shorter than rows * cols")
    px = np.frombuffer(raw, kind, n).astype(float)
    stored, high = _required(el, "bits_stored"), _required(el, "high_bit")
    if stored != bits:
        for _ in range(high - stored + 1):
            px = np.rint(px / 2)  # integer halving rounds to even
    slope, intercept = _numbers(el, "slope"), _numbers(el, "intercept")
    if TAGS["slope"][0] in el and TAGS["intercept"][0] in el:
        px = px * (slope[0] if slope else 1.0) + (intercept[0] if intercept else 0.0)
    return px


def read_frames(
    spark: SparkSession, root: str, *, pixels: bool = True, all_elements: bool = False,
    fail_fast: bool = False, only: str | None = None,
) -> DataFrame:
    """Frames below ``root`` with keys from their paths.

    ``only`` is an SQL predicate on ``patient_id, seq_type, seq_number, frame_number,
    path`` and is applied before the files are opened.  Undecodable files yield a row
    with ``error`` set, unless ``fail_fast``.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.dcm").load(root)
    )
    path = paths.slashes(F.col("path"))
    folder = paths.directory(path)
    keyed = files.select(
        "path", "content", paths.patient_id(path).alias("patient_id"), paths.sequence_type(folder).alias("seq_type"),
        paths.sequence_number(folder).alias("seq_number"), paths.frame_number(path).alias("frame_number"),
    )
    if only:
        keyed = keyed.where(only)
    keys = ["patient_id", "seq_type", "seq_number", "frame_number"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            records = []
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    record = decode(content, pixels, all_elements)
                except ValueError as exc:
                    if fail_fast:
                        raise ValueError(f"{p}: {exc}") from exc
                    record = {"error": str(exc)}
                records.append({c: None for c in FRAME_TYPES} | record | {"path": p})
            out = pd.DataFrame(records, index=pdf.index, columns=list(FRAME_TYPES))
            out = out.astype({"rows": "Int32", "cols": "Int32"})
            yield pd.concat([pdf[keys], out], axis=1)

    ddl = ", ".join(f"{c} {t}" for c, t in FRAME_TYPES.items())
    return keyed.mapInPandas(run, "patient_id int, seq_type string, seq_number int, frame_number int, " + ddl)
