"""Quality classifier: a byte-level convolutional network in numpy.

A document's UTF-8 bytes are covered by chunks of 256 with an overlap of 32. Within a chunk, bytes are embedded in 8 numbers,
learned filters of 8 bytes at a stride of 4 slide over it, and each filter's maximum over the chunk is taken. A small tanh layer
reads the maxima of a chunk; its outputs are averaged over all chunks of the document and give one probability.
Averages keep scores alike for short and long documents.

The network is fitted on the driver with a bounded sample: ``PER_LABEL`` labelled whole documents of each label,
picked by hashes; a step of training reads ``SEEN`` chunks of each of ``DOCS`` documents, drawn anew from all their chunks; loss weights restore the labels' true shares, so scores are probabilities. Scoring reads
every byte of every document, in one pass without a shuffle.

Defined cases: null text is scored as the empty one; without labels of both kinds the score is the share of label 1
(1 without labels); several labels of one document count by their largest; ties and repeated rows are scored alike; other columns
aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, groups, small_batches, table, utf8
from .nets import adam, chunks, id_crc, rows_of, sample_rows

CHUNK, STRIDE, TAPS, STEP, EMBED, FILTERS, HIDDEN = 256, 224, 8, 4, 8, 64, 16
PER_LABEL, STEPS, DOCS, SEEN, THRESHOLD = 1500, 600, 32, 10, 0.3


class Net:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = lambda *s, scale=1.0: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"e": f(256, EMBED, scale=0.5), "w": f(TAPS * EMBED, FILTERS, scale=0.2), "b": np.zeros(FILTERS, np.float32), "u": f(FILTERS, HIDDEN, scale=0.15), "c": np.zeros(HIDDEN, np.float32), "v": f(HIDDEN, scale=0.3), "d": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def _windows(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, taps * embed) of the bytes under each filter position."""
        e = self.p["e"][x]
        s = e.strides
        n = (x.shape[1] - TAPS) // STEP + 1
        return np.lib.stride_tricks.as_strided(e, (len(x), n, TAPS * EMBED), (s[0], s[1] * STEP, s[2]))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        w = np.ascontiguousarray(self._windows(x))
        a = w.reshape(-1, TAPS * EMBED) @ self.p["w"]
        return a.reshape(len(x), -1, FILTERS), w

    def chunk_vectors(self, x: np.ndarray) -> np.ndarray:
        a, _ = self.pooled(x)
        return np.tanh(np.maximum(a.max(1) + self.p["b"], 0) @ self.p["u"] + self.p["c"])

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each document."""
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        start, length, doc = chunks(off, CHUNK, STRIDE)
        total = np.zeros((n, HIDDEN))
        for i in range(0, len(doc), 128):
            part = slice(i, i + 128)
            np.add.at(total, doc[part], self.chunk_vectors(rows_of(buf, start[part], length[part], CHUNK)))
        z = total / np.bincount(doc, minlength=n)[:, None] @ self.p["v"].astype(np.float64) + self.p["d"][0]
        return 1 / (1 + np.exp(-z))

    def step(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, state: dict, lr: float) -> float:
        p, n = self.p, len(y)
        a, win = self.pooled(x)
        best = a.argmax(1)
        top = np.take_along_axis(a, best[:, None], 1)[:, 0] + p["b"]
        act = np.maximum(top, 0)
        h = np.tanh(act @ p["u"] + p["c"])
        size = np.bincount(doc, minlength=n).astype(np.float32)
        mean = np.zeros((n, HIDDEN), np.float32)
        np.add.at(mean, doc, h)
        mean /= size[:, None]
        z = mean @ p["v"] + p["d"][0]
        s = 1 / (1 + np.exp(-z))
        dz = ((s - y) * weight / weight.sum()).astype(np.float32)
        g = {"v": mean.T @ dz, "d": np.array([dz.sum()], np.float32)}
        dh = (dz[:, None] * p["v"] / size[:, None])[doc] * (1 - h * h)
        g["u"], g["c"] = act.T @ dh, dh.sum(0)
        dt = (dh @ p["u"].T) * (top > 0)
        g["b"] = dt.sum(0)
        seen = np.take_along_axis(win, best[:, :, None], 1)  # chunks, filters, taps * embed
        g["w"] = np.einsum("cfk,cf->kf", seen, dt, optimize=True).astype(np.float32)
        back = dt[:, :, None] * p["w"].T[None]
        at = x[np.arange(len(x))[:, None, None], best[:, :, None] * STEP + np.arange(TAPS)]
        ge = np.zeros((256, EMBED), np.float32)
        np.add.at(ge, at.reshape(-1), back.reshape(-1, EMBED))
        g["e"] = ge
        adam(p, g, state, lr)
        return float(-(weight * (y * np.log(s + 1e-9) + (1 - y) * np.log(1 - s + 1e-9))).sum() / weight.sum())


def train(texts: list[str], y: np.ndarray, prior: dict[int, float], steps: int = STEPS, seed: int = 7) -> Net:
    """Fit on texts with labels; prior: the true share of each label."""
    net = Net(seed)
    if len(set(y.tolist())) < 2:
        net.constant = float(prior.get(1, 0.0)) if prior else 1.0
        return net
    buf, off = utf8(pa.array(texts, pa.string()))
    start, length, doc = chunks(off, CHUNK, STRIDE)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    r, state = np.random.default_rng(seed), {}
    by = [np.flatnonzero(y == k) for k in (0, 1)]
    for t in range(steps):
        pick = np.concatenate([r.choice(b, DOCS // 2) for b in by])
        n = first[pick + 1] - first[pick]
        rows = np.concatenate([first[d] + (np.arange(k) if k <= SEEN else r.choice(k, SEEN, replace=False)) for d, k in zip(pick, n)])
        of = np.repeat(np.arange(len(pick)), np.minimum(n, SEEN))
        weight = np.where(y[pick] == 1, prior[1], prior[0]).astype(np.float32)
        weight = weight / weight.max()
        net.step(rows_of(buf, start[rows], length[rows], CHUNK), of, y[pick].astype(np.float32), weight, state, 0.01 * (1 - t / steps) + 0.0005)
    return net


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> Net:
    """Fit on a bounded sample of whole documents outside the held-out fifth."""
    lab = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).where(id_crc() % 5 != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids, counts = sample_rows(lab, "quality", per_label)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "quality").agg(F.min("t").alias("t"))  # one of the texts of an id
    rows = sorted(map(tuple, rows.collect()))
    total = sum(counts.values())
    return train([t for _, _, t in rows], np.array([q for _, q, _ in rows], int), {int(k): n / total for k, n in counts.items()}, steps)


def score(docs: DataFrame, net: Net, column: str = "score") -> DataFrame:
    """docs' doc_id and score, from whole texts."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(held.value, batch.column(1)))], names=["doc_id", column])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, `{column}` double")


def _scores(net: Net, texts: pa.Array) -> np.ndarray:
    buf, off = utf8(texts)
    return np.concatenate([np.zeros(0), *[net.scores(buf[off[a] : off[b]], off[a : b + 1] - off[a]) for a, b in groups(off, GROUP_BYTES)]])


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with their own columns, without those scored under threshold; labelled: the documents to fit on, if others.
    Only texts go to Python, and only a score comes back for each; rows stay in the JVM."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs if labelled is None else labelled, labels))

    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(held.value, texts), pa.float64())

    return docs.where(F.arrow_udf(scores, "double")(F.col("text")) >= threshold)


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    s = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return s.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
