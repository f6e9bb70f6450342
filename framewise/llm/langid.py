"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

Each document's UTF-8 bytes are cut into rows of 128. A GRU of 8 units reads a row forwards and another backwards; at every
position a softmax over both states labels the position, and a document's probabilities are the mean over all its positions. Rows are
laid out by time with thousands side by side, so each step is a few matrix operations; input weights are a table by byte.

Training is by backpropagation through time on the driver, with a bounded sample: ``PER_LANG`` whole documents of each language, picked
by hashes; every language that occurs is learned. Every byte of every
document is read in prediction, in one pass without a shuffle.

Defined cases: null text or text without a letter is ``und`` with score 0; without labelled rows every text is; with one
language only, that one with score 1; ties go to the language first by name; repeated rows are labelled alike; null languages aren't learned;
other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups, small_batches, table, utf8
from .nets import adam, chunks, id_crc, rows_of, sample_rows

UNITS, ROW, TRAIN_ROW = 8, 128, 64
PER_LANG, STEPS, BATCH = 400, 350, 192


class Net:
    """Gates in the order reset, update, new; x: input by byte (3H, 256), u: recurrent (3H, H), one each per direction."""

    def __init__(self, langs: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.langs, n = langs, len(langs)
        self.p = {}
        for d in "fb":
            self.p |= {"x" + d: f(3 * UNITS, 256, scale=0.4), "u" + d: f(3 * UNITS, UNITS, scale=0.3), "c" + d: np.zeros((UNITS, 1), np.float32), "v" + d: f(n, UNITS, scale=0.4)}
        self.p["o"] = np.zeros((n, 1), np.float32)

    def _forward(self, x: np.ndarray, d: str) -> Iterator[np.ndarray]:
        """States (H, rows) after each byte of x (time, rows); buffers are used again."""
        X, U, c, H, n = self.p["x" + d].copy(), self.p["u" + d].copy(), self.p["c" + d], UNITS, x.shape[1]
        X[: 2 * H] *= 0.5  # sigmoid(a) = (1 + tanh(a / 2)) / 2
        U[: 2 * H] *= 0.5
        h, g, a, s = np.zeros((H, n), np.float32), np.empty((3 * H, n), np.float32), np.empty((3 * H, n), np.float32), np.empty((H, n), np.float32)
        for row in x:
            np.take(X, row, axis=1, out=g, mode="clip")
            np.matmul(U, h, out=a)
            rz = a[: 2 * H]
            rz += g[: 2 * H]
            np.tanh(rz, out=rz)
            rz *= 0.5
            rz += 0.5
            np.add(a[2 * H :], c, out=s)
            s *= a[:H]
            s += g[2 * H :]
            np.tanh(s, out=s)
            h -= s
            h *= a[H : 2 * H]
            h += s
            yield h

    def position_sums(self, rows: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(languages, rows): probabilities summed over the positions of each row."""
        x = np.ascontiguousarray(rows.T).astype(np.intp)
        back = np.empty((len(x), len(self.langs), x.shape[1]), np.float32)
        for t, h in enumerate(self._forward(x[::-1], "b")):
            np.matmul(self.p["vb"], h, out=back[len(x) - 1 - t])
        total = np.zeros((len(self.langs), x.shape[1]), np.float32)
        for t, h in enumerate(self._forward(x, "f")):
            z = back[t]
            z += self.p["vf"] @ h
            z += self.p["o"]
            z -= z.max(0)
            np.exp(z, out=z)
            z /= z.sum(0)
            z *= t < length
            total += z
        return total

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(documents, languages) means over all positions."""
        n = len(off) - 1
        start, length, doc = chunks(off, ROW, ROW)
        out = np.zeros((n, len(self.langs)))
        for i in range(0, len(doc), 2048):
            part = slice(i, i + 2048)
            np.add.at(out, doc[part], self.position_sums(rows_of(buf, start[part], length[part], ROW), length[part]).T)
        return out / np.maximum(np.diff(off), 1)[:, None]

    def step(self, rows: np.ndarray, length: np.ndarray, y: np.ndarray, state: dict, lr: float) -> float:
        """One step of backpropagation through time; every position of a row has the row's language y."""
        p, H, n, T = self.p, UNITS, len(rows), rows.shape[1]
        x = np.ascontiguousarray(rows.T).astype(np.intp)
        seen, memory = (np.arange(T)[:, None] < length).astype(np.float32), {}
        for d in "fb":
            h, out = np.zeros((H, n), np.float32), []
            for row in x if d == "f" else x[::-1]:
                g, a = p["x" + d][:, row], p["u" + d] @ h
                r, z = 1 / (1 + np.exp(-(g[:H] + a[:H]))), 1 / (1 + np.exp(-(g[H : 2 * H] + a[H : 2 * H])))
                q = a[2 * H :] + p["c" + d]
                s = np.tanh(g[2 * H :] + r * q)
                new = s + z * (h - s)
                out.append((h, r, z, q, s, new))
                h = new
            memory[d] = out if d == "f" else out[::-1]
        z = np.stack([p["vf"] @ memory["f"][t][5] + p["vb"] @ memory["b"][t][5] for t in range(T)]) + p["o"]
        z -= z.max(1, keepdims=True)
        e = np.exp(z)
        e /= e.sum(1, keepdims=True)
        loss = -(np.log(e[:, y, np.arange(n)] + 1e-9) * seen).sum() / seen.sum()
        e[:, y, np.arange(n)] -= 1
        e *= seen[:, None, :] / seen.sum()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["o"] += e.sum((0, 2))[:, None]
        for d in "fb":
            order = range(T - 1, -1, -1) if d == "f" else range(T)
            dh, dx = np.zeros((H, n), np.float32), np.empty((T, 3 * H, n), np.float32)
            for t in order:
                h, r, zt, q, s, new = memory[d][t]
                g["v" + d] += e[t] @ new.T
                dh = dh + p["v" + d].T @ e[t]
                ds = dh * (1 - zt) * (1 - s * s)
                dz = dh * (h - s) * zt * (1 - zt)
                dr = ds * q * r * (1 - r)
                dq = ds * r
                dx[t, :H], dx[t, H : 2 * H], dx[t, 2 * H :] = dr, dz, ds
                da = np.concatenate([dr, dz, dq])
                g["u" + d] += da @ h.T
                g["c" + d] += dq.sum(1, keepdims=True)
                dh = dh * zt + p["u" + d].T @ da
            flat = dx.transpose(0, 2, 1).reshape(-1, 3 * H)
            byte = x.reshape(-1)
            g["x" + d] = np.stack([np.bincount(byte, flat[:, j], 256) for j in range(3 * H)]).astype(np.float32)
        adam(p, g, state, lr)
        return float(loss)


def train(texts: list[str], langs: list[str], steps: int = STEPS, seed: int = 5) -> Net:
    names = sorted(set(langs))
    net = Net(names, seed)
    if len(names) < 2:
        return net
    buf, off = utf8(pa.array(texts, pa.string()))
    start, length, doc = chunks(off, TRAIN_ROW, TRAIN_ROW)
    rows, y = rows_of(buf, start, length, TRAIN_ROW), np.array([names.index(x) for x in langs])[doc]
    by = [np.flatnonzero((y == k) & (length > 0)) for k in range(len(names))]
    by = [b for b in by if len(b)]
    r, state = np.random.default_rng(seed), {}
    for t in range(steps):
        pick = np.concatenate([r.choice(b, max(1, BATCH // len(by))) for b in by])
        net.step(rows[pick], length[pick], y[pick], state, 0.02 * (1 - t / steps) + 0.001)
    return net


def fit(docs: DataFrame, per_lang: int = PER_LANG, steps: int = STEPS) -> Net | None:
    """Fit on a bounded sample of whole documents outside the held-out quarter."""
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(id_crc() % 4 != 2).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    rows, _ = sample_rows(known, "lang", per_lang)
    rows = sorted(map(tuple, rows.select("doc_id", "lang", "text").collect()))
    return train([t for _, _, t in rows], [x for _, x, _ in rows], steps) if rows else None


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int64)])
    out = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~out & (np.diff(off) > 0)):
        out[i] = any(map(str.isalpha, buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")))
    return out


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, lang_pred and score, from whole texts."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            net, names, scores = held.value, [], []
            buf, off = utf8(batch.column(1))
            for lo, hi in groups(off):
                part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
                letters = has_letter(part, o)
                p = net.probabilities(part, o) if net else np.zeros((hi - lo, 1))
                best = p.argmax(1)
                names += [net.langs[b] if net and x else "und" for b, x in zip(best, letters)]
                scores += [float(min(1.0, p[i, b])) if net and x else 0.0 for i, (b, x) in enumerate(zip(best, letters))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs)).select("doc_id", (id_crc() % 4 == 2).alias("held_out"), "lang_pred", "score")
