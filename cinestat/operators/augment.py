"""Seeded image augmentation; the seed of a row is a hash of its key, never its position."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cinestat.functions.bind import let
from cinestat.functions.geometry import rotation_about
from cinestat.operators.pixels import warp_affine


def seeded_map(
    df: DataFrame, key: str, px: str, width: int, kernel: Callable[[np.ndarray, np.random.Generator], np.ndarray], seed: int
) -> DataFrame:
    """Apply ``kernel(image, generator)`` to every row; equal keys always draw the same numbers."""
    work = df.select(key, px, F.xxhash64(F.lit(seed), key).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [
                kernel(np.asarray(p, float).reshape(-1, width), np.random.default_rng(s & (2**63 - 1))).ravel()
                for p, s in zip(pdf[px], pdf["s"])
            ]
            yield pd.DataFrame({key: pdf[key], px: out})

    return work.mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {px} array<double>")


def warp(img: np.ndarray, inverse: np.ndarray, shape: tuple[int, int], order: int = 1) -> np.ndarray:
    """Sample at ``inverse @ (x, y, 1)`` of every output pixel; zero outside."""
    yy, xx = np.mgrid[0 : shape[0], 0 : shape[1]]
    x, y = np.einsum("ij,jhw->ihw", inverse[:2], np.stack([xx, yy, np.ones_like(xx)]))
    p = np.pad(img, 1)
    x, y = np.clip(x, -1, img.shape[1]) + 1, np.clip(y, -1, img.shape[0]) + 1
    if order == 0:
        return p[np.rint(y).astype(int), np.rint(x).astype(int)]
    x0, y0 = np.minimum(np.floor(x).astype(int), p.shape[1] - 2), np.minimum(np.floor(y).astype(int), p.shape[0] - 2)
    fx, fy = x - x0, y - y0
    top = p[y0, x0] * (1 - fx) + p[y0, x0 + 1] * fx
    return top * (1 - fy) + (p[y0 + 1, x0] * (1 - fx) + p[y0 + 1, x0 + 1] * fx) * fy


def about_centre(m: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Conjugate a 3x3 transform so that it acts around the middle of the image."""
    shift = np.eye(3)
    shift[:2, 2] = shape[1] / 2.0 - 0.5, shape[0] / 2.0 - 0.5
    back = np.eye(3)
    back[:2, 2] = -shift[:2, 2]
    return shift @ m @ back


def rotation(degrees: float) -> np.ndarray:
    a = np.radians(degrees)
    return np.array([[np.cos(a), -np.sin(a), 0.0], [np.sin(a), np.cos(a), 0.0], [0.0, 0.0, 1.0]])


def rotate(max_degrees: int) -> Callable:
    def kernel(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return warp(img, about_centre(rotation(rng.integers(-max_degrees, max_degrees)), img.shape), img.shape)

    return kernel


def shift(h_range: float, w_range: float) -> Callable:
    """Whole-pixel shift by up to the given share of the size; zero outside."""

    def kernel(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        dy = int((rng.random() * 2 - 1) * h_range * img.shape[0])
        dx = int((rng.random() * 2 - 1) * w_range * img.shape[1])
        move = np.array([[1.0, 0.0, -dx], [0.0, 1.0, -dy], [0.0, 0.0, 1.0]])
        return warp(img, move, img.shape, order=0)

    return kernel


def jitter(offset: float = 0.02, wave: float = 0.03, across: float = 0.06, down: float = 0.06) -> Callable:
    """Random brightness, a cosine curve of the intensity and a linear vignette."""

    def kernel(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        h, w = img.shape
        a, b, c, d = rng.normal(scale=[offset, wave, across, down])
        x, y = np.arange(w) / w - 0.5, np.arange(h) / h - 0.5
        return img + a + b * np.cos(img * np.pi / 2) + c * x[None, :] + d * y[:, None]

    return kernel


def affine(out_shape: tuple[int, int], zoom: float = 1.6, stretch: float = 1.3, shear: int = 40, move: int = 10) -> Callable:
    """Random zoom, stretch, rotation, shear, shift and mirror around the centre."""

    def kernel(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        s = np.exp(rng.uniform(-np.log(stretch), np.log(stretch)))
        z = np.exp(rng.uniform(-np.log(zoom), np.log(zoom)))
        r, k = np.radians(rng.integers(0, 360)), np.radians(rng.integers(-shear, shear))
        sx, sy = s / z, 1.0 / (z * s)
        tx, ty = rng.integers(-move, move, 2)
        m = np.array([
            [sx * np.cos(r), -sy * np.sin(r + k), tx], [sx * np.sin(r), sy * np.cos(r + k), ty], [0.0, 0.0, 1.0],
        ])
        out = warp(img, np.linalg.inv(about_centre(m, img.shape)), out_shape)
        return out[:, ::-1] if rng.integers(2) else out

    return kernel


def random_crop(w: int, h: int) -> Callable:
    def kernel(img: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        y, x = rng.integers(0, max(img.shape[0] - h, 1)), rng.integers(0, max(img.shape[1] - w, 1))
        return img[y : y + h, x : x + w]

    return kernel


def drawn(seed: int, key: Column, k: int) -> Column:
    """Number in [0, 1) that the seed, a row's key and ``k`` decide."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.lit(str(k))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0


def drawn_int(seed: int, key: Column, k: int, low: int, high: int) -> Column:
    """Whole number from ``low`` up to, not including, ``high``."""
    return F.floor(drawn(seed, key, k) * (high - low)) + low


def affine_of(
    px: Column, key: Column, width: int, height: int, seed: int, zoom: float = 1.6, stretch: float = 1.3, shear: int = 40, move: int = 10,
) -> Column:
    """An image under a zoom, stretch, rotation, shear, shift and mirroring around its centre, drawn by its key."""
    s = F.exp((2 * drawn(seed, key, 0) - 1) * F.log(F.lit(stretch)))
    z = F.exp((2 * drawn(seed, key, 1) - 1) * F.log(F.lit(zoom)))
    r, k = F.radians(drawn_int(seed, key, 2, 0, 360)), F.radians(drawn_int(seed, key, 3, -shear, shear))
    t = [drawn_int(seed, key, 4 + i, -move, move) for i in range(2)]
    values = {"s": s, "z": z, "r": r, "k": k, "tx": t[0], "ty": t[1], "mirror": drawn(seed, key, 6) < 0.5}

    def warped(v: Column) -> Column:
        sx, sy = v["s"] / v["z"], 1 / (v["z"] * v["s"])
        a, b = sx * F.cos(v["r"]), -sy * F.sin(v["r"] + v["k"])
        c, d = sx * F.sin(v["r"]), sy * F.cos(v["r"] + v["k"])
        cx, cy = width / 2 - 0.5, height / 2 - 0.5
        moved = [v["tx"] + cx - a * cx - b * cy, v["ty"] + cy - c * cx - d * cy]
        det = a * d - b * c
        back = [[d / det, -b / det], [-c / det, a / det]]
        rows = [[m, n, -(m * moved[0] + n * moved[1])] for m, n in back]
        # Mirrored: pixel x of the result is pixel width - 1 - x.
        rows = [[F.when(v["mirror"], -m).otherwise(m), n, F.when(v["mirror"], o + m * (width - 1)).otherwise(o)] for m, n, o in rows]
        named = F.struct(*[e.alias(f"e{i}{j}") for i, row in enumerate(rows) for j, e in enumerate(row)])
        return let(named, lambda e: warp_affine(px, width, height, [[e[f"e{i}{j}"] for j in range(3)] for i in range(2)], width, height))

    return let(F.struct(*[v.alias(n) for n, v in values.items()]), warped)


def rotated_of(px: Column, key: Column, width: int, height: int, seed: int, most: int) -> Column:
    """An image turned around its centre by whole degrees below ``most`` either way, drawn by its key."""
    angle = drawn_int(seed, key, 0, -most, most).cast("double")
    turn = rotation_about(angle, F.lit(width / 2 - 0.5), F.lit(height / 2 - 0.5))
    return warp_affine(px, width, height, turn, width, height)


def shifted_of(px: Column, key: Column, width: int, height: int, seed: int, h_range: float, w_range: float) -> Column:
    """An image moved by whole pixels, by up to a share of its size, drawn by its key; zero comes in."""
    dx, dy = (((2 * drawn(seed, key, k) - 1) * share * n).cast("int") for k, share, n in ((0, w_range, width), (1, h_range, height)))
    one, zero = F.lit(1.0), F.lit(0.0)
    return warp_affine(px, width, height, [[one, zero, -dx], [zero, one, -dy]], width, height)
