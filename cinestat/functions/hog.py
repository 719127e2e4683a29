"""Histogram-of-gradients descriptors and sliding-window scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cinestat.functions.stencils import Stack, map_images, shifted

# Window, block, stride and cell size, orientation bins, clipping level.
WINDOW, BLOCK, STRIDE, CELL, BINS, CLIP = 32, 16, 8, 8, 9, 0.05


def _cell_weights() -> np.ndarray:
    """(4, BLOCK*BLOCK): bilinear share of a pixel in each cell times a Gaussian window."""
    at = np.arange(BLOCK)
    to_first = np.clip(1.0 - ((at + 0.5) / CELL - 0.5), 0.0, 1.0)
    axis = np.stack([to_first, 1.0 - to_first])
    g = np.exp(-((at - (BLOCK - 1) / 2) ** 2) / (2 * (BLOCK / 4) ** 2))
    return np.einsum("ay,bx,y,x->abyx", axis, axis, g, g).reshape(4, BLOCK * BLOCK)


def orientation_maps(a: Stack) -> np.ndarray:
    """Gradient magnitude split over the two nearest of nine unsigned directions."""
    gx = shifted(a, 0, 1, "reflect") - shifted(a, 0, -1, "reflect")
    gy = shifted(a, 1, 0, "reflect") - shifted(a, -1, 0, "reflect")
    mag = np.hypot(gx, gy)
    pos = np.mod(np.arctan2(gy, gx), np.pi) * BINS / np.pi - 0.5
    low = np.floor(pos).astype(int)
    frac = pos - low
    maps = np.zeros((*a.shape, BINS))
    np.put_along_axis(maps, (low % BINS)[..., None], (mag * (1 - frac))[..., None], -1)
    high = np.zeros_like(maps)
    np.put_along_axis(high, ((low + 1) % BINS)[..., None], (mag * frac)[..., None], -1)
    return maps + high


def block_grid(a: Stack) -> np.ndarray:
    """Normalised block histograms at every stride: (n, rows, cols, 36)."""
    maps, w = orientation_maps(a), _cell_weights()
    n, h, wd = a.shape
    ys, xs = range(0, h - BLOCK + 1, STRIDE), range(0, wd - BLOCK + 1, STRIDE)
    out = np.zeros((n, len(ys), len(xs), 4 * BINS))
    for i, y in enumerate(ys):
        for j, x in enumerate(xs):
            pixels = maps[:, y : y + BLOCK, x : x + BLOCK].reshape(n, BLOCK * BLOCK, BINS)
            out[:, i, j] = np.einsum("cp,npb->ncb", w, pixels).reshape(n, -1)
    out /= np.sqrt((out**2).sum(-1, keepdims=True)) + 0.1 * 4 * BINS
    out = np.minimum(out, CLIP)
    return out / (np.sqrt((out**2).sum(-1, keepdims=True)) + 1e-3)


def descriptor(a: Stack) -> np.ndarray:
    """Descriptor of window-sized images: (n, 324)."""
    return block_grid(a).reshape(len(a), -1)


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear resampling of one image (centres at half integers)."""
    y = np.clip((np.arange(h) + 0.5) * img.shape[0] / h - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * img.shape[1] / w - 0.5, 0, img.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = img[y0][:, x0] * (1 - fx) + img[y0][:, x1] * fx
    return top * (1 - fy) + (img[y1][:, x0] * (1 - fx) + img[y1][:, x1] * fx) * fy


def detect(images: DataFrame, id_: str, px: str, width: int, weights: np.ndarray, bias: float, factor: float = 1.05) -> DataFrame:
    """Windows with a positive score at every scale: ``(id, x, y, w, h, score)``.

    Image and scale are the unit of work, so that large images spread over tasks.
    """
    side = WINDOW // STRIDE - 1
    kernel = weights.reshape(side, side, 4 * BINS)
    steps = F.floor(F.log(F.least(F.lit(width), F.size(px) / width) / F.lit(float(WINDOW))) / F.log(F.lit(factor)))
    work = images.select(id_, px, F.explode(F.sequence(F.lit(0), F.greatest(steps, F.lit(0)).cast("int"))).alias("level"))

    def score(batches):
        for pdf in batches:
            rows = []
            for key, flat, level in pdf.itertuples(index=False):
                img, s = np.asarray(flat, float).reshape(-1, width), factor**level
                h, w = round(img.shape[0] / s), round(img.shape[1] / s)
                if min(h, w) < WINDOW:
                    continue
                blocks = block_grid(resized(img, h, w)[None])[0]
                for i in range(blocks.shape[0] - side + 1):
                    for j in range(blocks.shape[1] - side + 1):
                        value = float((blocks[i : i + side, j : j + side] * kernel).sum() + bias)
                        if value > 0:
                            rows.append((key, j * STRIDE * s, i * STRIDE * s, WINDOW * s, WINDOW * s, value))
            yield pd.DataFrame(rows, columns=[id_, "x", "y", "w", "h", "score"])

    kind = dict(images.dtypes)[id_]
    return work.repartition(id_, "level").mapInPandas(score, f"{id_} {kind}, x double, y double, w double, h double, score double")


def descriptors(df: DataFrame, px: str, out: str, width: int = WINDOW) -> DataFrame:
    """Descriptor of every window-sized image."""
    return map_images(df, px, descriptor, width, out)
