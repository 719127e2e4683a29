"""Neighbourhood operators on whole images, vectorised over an Arrow batch.

Catalyst has no stencil expression.  Each kernel is a few numpy lines on a stack
``(n, h, w)``; Spark decides where the images live and how many form a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

Stack = np.ndarray

# Pixels of a stack that a kernel gets at once: what it works out is some ten times as large.
STACK_PIXELS = 1 << 18


def map_images(df: DataFrame, px: str, kernel: Callable[[Stack], Stack], width: int, out: str) -> DataFrame:
    """Append ``out``: a stack kernel applied to row-major images of one width.

    Works on the Arrow buffers: images of equal sizes become stacks of at most
    ``STACK_PIXELS`` (one image at least) without a copy per row, images of different heights
    are stacked per size, NULL stays NULL.  The other columns pass through untouched.
    """
    work = df.withColumn(px, F.col(px).cast("array<double>"))
    schema = T.StructType([*work.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(px)
            flat, size = col.flatten().to_numpy(), col.value_lengths().fill_null(-1).to_numpy()
            start = np.concatenate([[0], np.cumsum(np.maximum(size, 0))])
            done: list[np.ndarray | None] = [None] * len(col)
            for n in np.unique(size[size > 0]):
                at = np.flatnonzero(size == n)
                most = max(1, STACK_PIXELS // int(n))
                for part in (at[k : k + most] for k in range(0, len(at), most)):
                    stack = flat[start[part][:, None] + np.arange(n)].reshape(len(part), n // width, width)
                    for i, row in zip(part, kernel(stack).reshape(len(part), -1)):
                        done[i] = row
            ends = np.cumsum([0, *(0 if r is None else len(r) for r in done)]).astype("int32")
            rows = [r for r in done if r is not None]
            values = pa.array(np.concatenate(rows) if rows else np.empty(0), pa.float64())
            offsets = pa.array(ends, pa.int32(), mask=np.array([*(r is None for r in done), False]))
            result = pa.ListArray.from_arrays(offsets, values)
            yield pa.RecordBatch.from_arrays([*batch.columns, result], [*batch.schema.names, out])

    return work.mapInArrow(run, schema)


def shifted(a: Stack, dy: int, dx: int, mode: str = "edge") -> Stack:
    """Value of the neighbour at (+dy, +dx); borders by numpy padding mode."""
    ry, rx = abs(dy), abs(dx)
    p = np.pad(a, ((0, 0), (ry, ry), (rx, rx)), mode=mode)
    return p[:, ry + dy : ry + dy + a.shape[1], rx + dx : rx + dx + a.shape[2]]


def convolve(a: Stack, kernel: np.ndarray, mode: str = "constant") -> Stack:
    """Correlation with an odd kernel; zero borders by default."""
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    out = np.zeros_like(a)
    for (i, j), k in np.ndenumerate(kernel):
        out += k * shifted(a, i - ry, j - rx, mode)
    return out


# The 3x3 Sobel weights along x.
SOBEL_X = np.array([[-1.0, 0.0, 1.0], [-2.0, 0.0, 2.0], [-1.0, 0.0, 1.0]])


def sobel(a: Stack) -> tuple[Stack, Stack]:
    return convolve(a, SOBEL_X, "reflect"), convolve(a, SOBEL_X.T, "reflect")


def gradient_magnitude(a: Stack) -> Stack:
    dx, dy = sobel(a)
    return np.hypot(dx, dy)


def perona_malik(a: Stack, k: float, dt: float, total: float) -> Stack:
    """Edge-stopping diffusion: explicit steps of size ``dt`` up to time ``total``."""
    for _ in np.arange(0.0, total, dt):
        dx, dy = sobel(a)
        g = 1.0 / (1.0 + (dx**2 + dy**2) / k**2)
        g[:, [0, -1], :] = 1.0
        g[:, :, [0, -1]] = 1.0
        flow = sum(
            (shifted(g, *d) + g) * (shifted(a, *d) - a) for d in ((1, 0), (0, 1), (-1, 0), (0, -1))
        )
        a = a + dt * flow / 4.0
    return a


def curvature(u: Stack, eta: float = 1e-8) -> Stack:
    """Divergence of the normalised gradient of a level set."""
    fx, fy = shifted(u, 0, 1) - u, shifted(u, 1, 0) - u
    cx = (shifted(u, 0, 1) - shifted(u, 0, -1)) / 2
    cy = (shifted(u, 1, 0) - shifted(u, -1, 0)) / 2
    nx, ny = fx / np.sqrt(fx**2 + cx**2 + eta**2), fy / np.sqrt(fy**2 + cy**2 + eta**2)
    return (nx - shifted(nx, 0, -1)) + (ny - shifted(ny, -1, 0))


def chan_vese(
    a: Stack, init: Stack, *, steps: int = 1000, dt: float = 1.0, mu: float = 0.5, nu: float = 0.0,
    lambda1: float = 1.0, lambda2: float = 1.0, eps: float = 1.0, tol: float = 1e-3,
) -> tuple[Stack, np.ndarray]:
    """Two-region level set; every image stops on its own once its update is small.

    Also tells for each image whether it did so within ``steps``.
    """
    u = np.broadcast_to(init, a.shape).astype(float).copy()
    stop = tol * np.sqrt((a**2).sum(axis=(1, 2)))
    active = np.arange(len(a))
    for _ in range(steps):
        img, lev = a[active], u[active]
        h = 0.5 * (1.0 + 2.0 / np.pi * np.arctan(lev / eps))
        c1 = (img * h).sum(axis=(1, 2), keepdims=True) / h.sum(axis=(1, 2), keepdims=True)
        c2 = (img * (1 - h)).sum(axis=(1, 2), keepdims=True) / (1 - h).sum(axis=(1, 2), keepdims=True)
        force = -lambda1 * (img - c1) ** 2 + lambda2 * (img - c2) ** 2
        step = dt * (mu * curvature(lev) - nu + force) * eps / (np.pi * (eps**2 + lev**2))
        u[active] = lev + step
        moving = np.sqrt((step**2).sum(axis=(1, 2))) > stop[active]
        active = active[moving]
        if not len(active):
            break
    return u, ~np.isin(np.arange(len(a)), active)


def with_flag(result: tuple[Stack, np.ndarray]) -> np.ndarray:
    """Images and a flag for each as rows: the flag comes last, as 0 or 1."""
    images, flags = result
    return np.concatenate([images.reshape(len(images), -1), flags[:, None]], axis=1)


def gaussian_kernel(size: int, sigma: float = 2.0) -> np.ndarray:
    at = np.arange(size) - (size - 1) / 2
    g = np.exp(-(at[:, None] ** 2 + at[None, :] ** 2) / (2 * sigma**2))
    return g / g.sum()


def local_contrast(a: Stack, size: int = 9, threshold: float = 1e-4) -> Stack:
    """Subtract the Gaussian neighbourhood mean, divide by its norm (floored per image)."""
    g = gaussian_kernel(size)
    norm = np.sqrt(convolve(a**2, g))
    floor = norm.mean(axis=(1, 2), keepdims=True)
    return (a - convolve(a, g)) / np.maximum(np.maximum(floor, norm), threshold)


def tv_denoise(a: Stack, weight: float = 0.1, eps: float = 2e-4, max_steps: int = 200) -> tuple[Stack, np.ndarray]:
    """Total-variation smoothing by dual projection; every image stops on its own.

    Also tells for each image whether it did so within ``max_steps``.
    """
    out = a.copy()
    p = np.zeros((2, *a.shape))
    first, before = np.zeros(len(a)), np.zeros(len(a))
    active = np.arange(len(a))
    size = a.shape[1] * a.shape[2]
    for i in range(max_steps):
        px, py, img = p[0][active], p[1][active], a[active]
        d = -px - py
        d[:, 1:, :] += px[:, :-1, :]
        d[:, :, 1:] += py[:, :, :-1]
        cur = img + d
        gx, gy = np.zeros_like(cur), np.zeros_like(cur)
        gx[:, :-1, :] = np.diff(cur, axis=1)
        gy[:, :, :-1] = np.diff(cur, axis=2)
        norm = np.sqrt(gx**2 + gy**2)
        energy = ((d**2).sum(axis=(1, 2)) + weight * norm.sum(axis=(1, 2))) / size
        scale = 1.0 + 0.25 / weight * norm
        p[0][active], p[1][active] = (px - 0.25 * gx) / scale, (py - 0.25 * gy) / scale
        out[active] = cur
        if i == 0:
            first[active] = energy
            going = np.ones(len(active), bool)
        else:
            going = np.abs(before[active] - energy) >= eps * first[active]
        before[active] = energy
        active = active[going]
        if not len(active):
            break
    return out, ~np.isin(np.arange(len(a)), active)
