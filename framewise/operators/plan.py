"""Sampling and probe plans: sequential choices over one title's few boundaries, pieces or probes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .groups import whole_groups


def gop_strata(keys: list[int], n: int, target: int, clip: int) -> list[int]:
    """First frames of strata of whole GOPs, ``target`` frames or more each; a GOP of twice that is cut evenly, and a stratum too short for two clips
    joins the one before."""
    target = max(target, 2 * clip)
    cuts = [0]
    for a, b in pairwise(sorted({0, n, *(k for k in keys if 0 < k < n)})):
        if b - a >= 2 * target:
            parts = (b - a + target // 2) // target
            cuts += [a + (b - a) * p // parts for p in range(parts + 1)]
        elif b - cuts[-1] >= target:
            cuts.append(b)
    cuts = sorted({*cuts, n})
    return [a for a, b in pairwise(cuts) if a == 0 or b - a >= 2 * clip]


def scene_strata(bounds: list[int], n: int, clip: int) -> list[int]:
    """First frames of scenes; one too short for a clip joins the one before, or takes in the next if it is the first."""
    firsts: list[int] = []
    for a, b in pairwise(sorted({0, n, *(k for k in bounds if 0 < k < n)})):
        if not firsts or (b - a >= clip and a - firsts[-1] >= clip):
            firsts.append(a)
    return firsts


def strata(keys: DataFrame, target: int, clip: int, scenes: bool = False) -> DataFrame:
    """keys: video_id, idx (of key frames or cuts), n (frames of the video). video_id, stratum, first, last (exclusive)."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, at = int(g["n"].iloc[0]), [int(k) for k in g["idx"]]
        first = scene_strata(at, n, clip) if scenes else gop_strata(at, n, target, clip)
        return pd.DataFrame({"video_id": g["video_id"].iloc[0], "stratum": range(len(first)), "first": first, "last": [*first[1:], n]})

    return keys.groupBy("video_id").applyInPandas(run, "video_id long, stratum int, first long, last long")


def take_near(pieces: DataFrame, budget: int, score: Column) -> DataFrame:
    """pieces (title, id, length) from the highest score on, each taken if it brings the total nearer to the budget; one at least."""
    g = pieces.groupBy("title").agg(F.array_sort(F.collect_list(F.struct((-score).alias("s"), "id", "length"))).alias("p"))
    zero = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("ids"))

    def step(a: Column, x: Column) -> Column:
        nearer = F.abs(budget - a["sum"] - x["length"]) < F.abs(budget - a["sum"])
        return F.when(nearer | (F.size(a["ids"]) == 0), F.struct((a["sum"] + x["length"]).alias("sum"), F.concat(a["ids"], F.array(x["id"])).alias("ids"))).otherwise(a)

    return g.select("title", F.explode(F.aggregate("p", zero, step)["ids"]).alias("id"))


def parabola(crf: Column, crf_a: Column, crf_b: Column, a: Column, b: Column, bend: float) -> Column:
    """Through both measurements with the given bend, flat from its turning point on, so that it never rises with the CRF."""
    slope = (b - a) / F.nullif(crf_b - crf_a, F.lit(0.0))
    at = crf
    if bend:
        turn = (crf_a + crf_b) / 2 - slope / (2 * bend)
        at = F.least(crf, turn) if bend > 0 else F.greatest(crf, turn)
    return F.coalesce(a + slope * (at - crf_a) + bend * (at - crf_a) * (at - crf_b), a)


def balanced_digest(pieces: DataFrame, features: list[str], slots: int, sweeps: int = 50) -> DataFrame:
    """pieces (title, id, features): one piece a slot (equal runs in order of id), chosen by coordinate descent so that the mean of the chosen lies nearest
    to the title's in standardised features; the first of equals. A title's pieces are one group."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        x = g[features].to_numpy(float)
        sd = x.std(0)
        x = (x - x.mean(0)) / np.where(sd > 0, sd, 1)
        parts = [p for p in np.array_split(np.arange(len(x)), min(slots, len(x))) if len(p)]
        chosen = [int(p[len(p) // 2]) for p in parts]
        for _ in range(sweeps):
            before = list(chosen)
            for i, p in enumerate(parts):
                rest = x[chosen].sum(0) - x[chosen[i]]
                off = np.round((((rest + x[p]) / len(parts)) ** 2).sum(1), 12)
                if off.min() < off[list(p).index(chosen[i])]:
                    chosen[i] = int(p[off.argmin()])
            if chosen == before:
                break
        return pd.DataFrame({"title": g["title"].iloc[0], "slot": range(len(chosen)), "id": g["id"].to_numpy()[chosen]})

    return pieces.groupBy("title").applyInPandas(run, "title long, slot int, id long")


def smoothed(x: np.ndarray, y: np.ndarray, starts: np.ndarray, curvature: float) -> tuple[np.ndarray, np.ndarray]:
    """``smooth_curve`` of each run of x and y that begins at ``starts``, all in one go: fitted values and standard errors."""
    n = np.diff([*starts, len(x)])
    of = np.repeat(np.arange(len(starts)), n)
    total = lambda v: np.add.reduceat(v, starts, axis=0)
    z = x - x[starts][of]  # equal rates have no spread, to the last digit
    z = z - (total(z) / n)[of]
    sd = np.sqrt(total(z * z) / n)
    v = [(z / np.where(sd == 0, 1.0, sd)[of]) ** k for k in range(4)]
    cells = [(j, k) for j in range(4) for k in range(4)]
    squares = np.stack([total(v[j] * v[k]) for j, k in cells], 1).reshape(-1, 4, 4)
    inverse = np.linalg.inv(squares + np.diag([1e-9, 1e-9, curvature, curvature]))
    weights = np.einsum("gjk,gk->gj", inverse, np.stack([total(c * y) for c in v], 1))
    fit = sum(weights[of, j] * v[j] for j in range(4))
    noise = total((y - fit) ** 2) / np.maximum(1, n - 2)
    return fit, np.sqrt(noise[of] * sum(inverse[of, j, k] * v[j] * v[k] for j, k in cells))


def smooth_curve(probes: DataFrame, curvature: float = 1.0) -> DataFrame:
    """probes (title, height, bitrate, vmaf): a cubic of vmaf in standardised ln(bitrate) for each curve, with a Gaussian prior that keeps its
    second and third coefficients near 0; fitted and standard error at each probe. Curves lie sorted in their partitions and stream through, many
    in a batch."""
    by = ["title", "height"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, starts in whole_groups(batches, by):
            with np.errstate(all="ignore"):
                fit, error = smoothed(np.log(pdf["bitrate"].to_numpy(float)), pdf["vmaf"].to_numpy(float), starts, curvature)
            yield pdf[[*by, "bitrate"]].assign(fitted=fit, error=error)

    ship(probes.sparkSession)
    p = probes.select(*by, "bitrate", F.col("vmaf").cast("double").alias("vmaf"))
    return p.repartition(*by).sortWithinPartitions(*by, "bitrate", "vmaf").mapInPandas(run, "title long, height int, bitrate long, fitted double, error double")
