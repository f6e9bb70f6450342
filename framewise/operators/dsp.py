"""Audio kernels over ordered samples: K-weighting and true peaks. State runs through a channel, so a channel's samples are one ordered group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Fixed values of ITU-R BS.1770: the analog prototypes of its two filters (Hz, dB, Q).
SHELF_HZ, SHELF_DB, SHELF_Q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
PASS_HZ, PASS_Q = 38.13547087602444, 0.5003270373238773


def shelf(rate: float) -> tuple[np.ndarray, np.ndarray]:
    k, vh = math.tan(math.pi * SHELF_HZ / rate), 10 ** (SHELF_DB / 20)
    vb, a0 = vh**0.4996667741545416, 1 + k / SHELF_Q + k * k
    b = np.array([vh + vb * k / SHELF_Q + k * k, 2 * (k * k - vh), vh - vb * k / SHELF_Q + k * k]) / a0
    return b, np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / SHELF_Q + k * k) / a0])


def high_pass(rate: float) -> tuple[np.ndarray, np.ndarray]:
    k = math.tan(math.pi * PASS_HZ / rate)
    a0 = 1 + k / PASS_Q + k * k
    return np.array([1.0, -2.0, 1.0]), np.array([1.0, 2 * (k * k - 1) / a0, (1 - k / PASS_Q + k * k) / a0])


def biquad(x: np.ndarray, b: np.ndarray, a: np.ndarray, block: int = 128) -> np.ndarray:
    """The recursive filter as matrix products over blocks: a block's output is its own response and that of the two numbers of state before it."""
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    into = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    seen = np.empty((block, 2))  # output of each sample from the state at the block's start
    m = np.eye(2)
    for i in range(block):
        seen[i], m = m[0], step @ m
    pulse = np.concatenate([[b[0]], seen[:-1] @ into])
    own = np.array([[pulse[i - j] if i >= j else 0.0 for j in range(block)] for i in range(block)])
    carry = np.stack([np.linalg.matrix_power(step, block - 1 - j) @ into for j in range(block)], axis=1)
    n = len(x)
    blocks = np.pad(x, (0, -n % block)).reshape(-1, block)
    feed, state, out = blocks @ carry.T, np.zeros(2), blocks @ own.T
    for i in range(len(blocks)):
        out[i] += seen @ state
        state = m @ state + feed[i]
    return out.ravel()[:n]


def k_weighted(x: np.ndarray, rate: float = 48000) -> np.ndarray:
    return biquad(biquad(x, *shelf(rate)), *high_pass(rate))


def oversampled(x: np.ndarray, times: int = 4, taps: int = 48) -> np.ndarray:
    """Band-limited interpolation by a windowed sinc of ``taps`` taps, in ``times`` phases."""
    t = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(t / times) * np.hanning(taps + 2)[1:-1]
    phases = [h[p::times] / h[p::times].sum() for p in range(times)]
    return np.stack([np.convolve(x, p)[: len(x)] for p in phases], axis=1).ravel()


def true_peak_db(x: np.ndarray) -> float:
    peak = max(float(np.abs(oversampled(x)).max()), float(np.abs(x).max())) if len(x) else 0.0
    return round(max(-120.0, 20 * math.log10(peak)) if peak > 0 else -120.0, 2)


def weighted_steps(samples: DataFrame, per_step: int, rate: float = 48000) -> DataFrame:
    """samples: video_id, pts, pos, x. The mean K-weighted energy of each step; a short last step is divided by its own length."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        e = k_weighted(g.sort_values(["pts", "pos"])["x"].to_numpy(float), rate) ** 2
        at = np.arange(0, len(e), per_step)
        mean = np.add.reduceat(e, at) / np.diff(np.append(at, len(e)))
        return pd.DataFrame({"video_id": g["video_id"].iloc[0], "step": np.arange(len(at)), "energy": mean})

    return samples.groupBy("video_id").applyInPandas(run, "video_id long, step long, energy double")


def true_peaks(samples: DataFrame) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"video_id": [g["video_id"].iloc[0]], "dbtp": [true_peak_db(g.sort_values(["pts", "pos"])["x"].to_numpy(float))]})

    return samples.groupBy("video_id").applyInPandas(run, "video_id long, dbtp double")
