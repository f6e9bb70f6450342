"""Kernels over frames (rows of luma values, width given): batches of frames are one numpy array, and no frame leaves its row.

Kernels that need the frame before get it as a column, so that the order is Spark's window and not the batch's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dark_share(luma: Column, black: float) -> Column:
    return F.size(F.filter(luma, lambda v: v <= black)) / F.size(luma)


def luma_stats(luma: Column, low: int = 16, high: int = 235) -> Column:
    """mean, min, max and the share out of range; inside generated code."""
    mean = F.aggregate(luma, F.lit(0.0), lambda s, v: s + v) / F.size(luma)
    out = F.size(F.filter(luma, lambda v: (v < low) | (v > high))) / F.size(luma)
    return F.struct(mean.alias("mean"), F.array_min(luma).alias("min"), F.array_max(luma).alias("max"), out.alias("out"))


def downscale(f: np.ndarray, by: int) -> np.ndarray:
    """Box means; (frames, height, width)."""
    n, h, w = f.shape
    return f[:, : h // by * by, : w // by * by].reshape(n, h // by, by, w // by, by).mean((2, 4))


def spatial_info(f: np.ndarray) -> np.ndarray:
    """Population deviation of the Sobel magnitude over inner pixels."""
    t, m, b = f[:, :-2], f[:, 1:-1], f[:, 2:]
    gx = (t[:, :, 2:] - t[:, :, :-2]) + 2 * (m[:, :, 2:] - m[:, :, :-2]) + (b[:, :, 2:] - b[:, :, :-2])
    gy = (b[:, :, :-2] + 2 * b[:, :, 1:-1] + b[:, :, 2:]) - (t[:, :, :-2] + 2 * t[:, :, 1:-1] + t[:, :, 2:])
    return np.hypot(gx, gy).std((1, 2))


def temporal_info(f: np.ndarray, before: np.ndarray) -> np.ndarray:
    return (f - before).std((1, 2))


def grain_sigma(f: np.ndarray) -> np.ndarray:
    """Immerkaer's estimate: mean absolute response to the difference of two Laplacians."""
    kernel = np.array([[1, -2, 1], [-2, 4, -2], [1, -2, 1]], float)
    h, w = f.shape[1] - 2, f.shape[2] - 2
    lap = sum(kernel[i, j] * f[:, i : i + h, j : j + w] for i in range(3) for j in range(3))
    return np.sqrt(np.pi / 2) * np.abs(lap).mean((1, 2)) / 6


def content_box(f: np.ndarray, black: float) -> np.ndarray:
    """x0, y0, x1, y1 (exclusive) of the pixels over black; an empty box for a black frame."""
    on = f > black
    rows, cols = on.any(2), on.any(1)
    first = lambda a: a.argmax(1)
    last = lambda a: np.where(a.any(1), a.shape[1] - a[:, ::-1].argmax(1), 0)
    return np.stack([first(cols), first(rows), last(cols), last(rows)], 1)


def motion(f: np.ndarray, before: np.ndarray, reach: int) -> np.ndarray:
    """dx, dy of the whole frame against the one before: the shift of least mean absolute difference over the shared area, the smallest of equals."""
    n, h, w = f.shape
    best, out = np.full(n, np.inf), np.zeros((n, 2), np.int64)
    shifts = sorted(((x, y) for x in range(-reach, reach + 1) for y in range(-reach, reach + 1)), key=lambda s: (s[0] ** 2 + s[1] ** 2, s))
    for x, y in shifts:
        now = f[:, max(y, 0) : h + min(y, 0), max(x, 0) : w + min(x, 0)]
        then = before[:, max(-y, 0) : h - max(y, 0), max(-x, 0) : w - max(x, 0)]
        d = np.abs(now - then).mean((1, 2))
        less = d < best - 1e-12
        best[less], out[less] = d[less], (x, y)
    return out


def mapped(frames: DataFrame, width: int, fields: str, kernel: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """frames (video_id, pos, luma, before) with a kernel's columns; a frame without one before is compared with itself. Null or uneven frames give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            for size, g in b.groupby(b["luma"].map(len)):
                f = np.stack(g["luma"].to_numpy()).astype(float).reshape(-1, size // width, width)
                prev = [p if p is not None and len(p) == size else x for p, x in zip(g["before"], g["luma"])]
                p = np.stack(prev).astype(float).reshape(f.shape)
                yield pd.DataFrame({"video_id": g["video_id"].to_numpy(), "pos": g["pos"].to_numpy(), **kernel(f, p)})

    usable = frames.where(F.col("luma").isNotNull() & (F.size("luma") >= 3 * width) & (F.size("luma") % width == 0))
    return usable.select("video_id", "pos", "luma", "before").mapInPandas(run, f"video_id long, pos long, {fields}")
