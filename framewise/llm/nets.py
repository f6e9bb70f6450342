"""Small pieces for the numpy networks: Adam, the bounded labelled sample, and byte chunks of documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adam(params: dict[str, np.ndarray], grads: dict[str, np.ndarray], state: dict, lr: float) -> None:
    state["t"] = t = state.get("t", 0) + 1
    norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
    scale = min(1.0, 5.0 / (norm + 1e-9))
    for k, g in grads.items():
        g = g * scale
        m = state.setdefault("m" + k, np.zeros_like(g))
        v = state.setdefault("v" + k, np.zeros_like(g))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        params[k] -= (lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)).astype(params[k].dtype)


def id_crc(c: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")))


def sample_rows(labelled: DataFrame, label: str, per_label: int) -> tuple[DataFrame, dict]:
    """At most per_label rows of each label, those of the smallest hashes of id and row, with their label; and the labels' counts.

    A first pick by hash leaves some more than that, so that only few rows are ranked."""
    counts = {r[0]: r[1] for r in labelled.groupBy(label).count().collect()}  # as many as labels
    if not counts:
        return labelled.limit(0), counts
    place = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    n = F.element_at(F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv]), F.col(label))
    few = labelled.where(F.pmod(place, F.lit(1 << 30)) * n < F.lit((1 << 30) * (per_label + 6.0 * per_label**0.5 + 20.0)))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(place, *[F.col(c) for c in labelled.columns]))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= per_label).drop("_rank"), counts


def chunks(off: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of the chunks that cover documents whole; an empty document has one empty chunk."""
    n = np.diff(off)
    k = np.maximum(1, -(-(n - (size - stride)) // stride)).astype(np.int64)
    doc = np.repeat(np.arange(len(n)), k)
    i = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
    start = off[:-1][doc] + i * stride
    return start, np.minimum(size, off[1:][doc] - start), doc


def rows_of(buf: np.ndarray, start: np.ndarray, length: np.ndarray, size: int) -> np.ndarray:
    """(chunks, size) bytes, zero beyond each chunk's length."""
    at = start[:, None] + np.arange(size)
    inside = np.arange(size) < length[:, None]
    padded = buf if len(buf) else np.zeros(1, np.uint8)
    return np.where(inside, padded[np.minimum(at, len(padded) - 1)], 0).astype(np.uint8)
