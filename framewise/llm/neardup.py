"""Near-duplicate documents: BagMinHash signatures of word-shingle multisets, banding, and verified multiset overlap.

Each document is the multiset of its runs of five words (lower-cased; a document of one to four words is one shingle). For every shingle
the weight axis is cut into the bands [0,1), [1,2), [2,4), [4,8) ...; each band is a Poisson process whose rate is its
width, whose points carry a slot of the signature and a discrete weight level, and a point counts if its level lies
under the shingle's weight. The earliest counting point of each slot is the signature: two documents agree in a slot
with probability equal to their weighted Jaccard similarity. Points are generated in order of time and only while a
process can still reach a slot, so heavy weights cost a logarithm.

128 slots make 32 bands of 4: a pair at 0.8 shares none of them with probability 5e-8. Equal texts (equal word sequences)
are one member throughout, so copies cost nothing. In each bucket all members are first compared with one centre, which links groups of copies by
as many pairs as they have members. Only buckets that still hold different linked sets are looked at further: their members go in blocks of ``BLOCK`` with their
shingles and a sketch of 128 bytes each, every two blocks of a bucket meet once, and pairs of different sets whose sketches leave room for the similarity
(an estimate ``MARGIN`` under it; missed with probability 1e-5 at 0.8, less above) are verified there, each in the first bucket it shares; only links
leave the task. So no group emits all its pairs, and no cap is set. Centres with many members are spread by Spark's skew join.

The verified overlap is sum(min) / sum(max) of the two multisets, of 32-bit shingle hashes.

Defined cases: texts without words are equal only if they are the same text, null being the empty one; a null doc_id is
in no class (null) and links nothing; rows of the same doc_id share its class, and if their texts differ each of
them is compared and the classes of all are one; empty tables give empty results; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, durable, groups, mix, small_batches, table, tidy, utf8

WORDS, SIMILAR, SLOTS, ROWS = 5, 0.8, 128, 4
#: Ids (8 bytes each) that may be broadcast to pick documents for verification; more are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: Documents of a block of a bucket, pairs of blocks in a batch, and how far an estimate from a sketch may lie under the similarity it
#: is to be verified at (4.3 standard deviations).
BLOCK, BLOCK_ROWS, MARGIN = 64, 16, 0.15
_STEP, _BAND = np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F)


# ---- signatures -----------------------------------------------------------------------------------------------
def shingles(w: Words, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of every shingle, repeats included."""
    at, h = w.windows(n)
    docs, hashes = [w.doc[at]], [h]
    size = np.diff(w.first)
    for k in range(1, n):
        if (size == k).any():
            at, h = w.windows(k)
            some = size[w.doc[at]] == k
            docs.append(w.doc[at][some])
            hashes.append(h[some])
    return np.concatenate(docs), np.concatenate(hashes)


def bag_minhash(doc: np.ndarray, h: np.ndarray, n_docs: int, m: int = SLOTS) -> np.ndarray:
    """(n_docs, m) signatures of the shingle multisets; zeros for a document without shingles."""
    best, sig = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, np.uint64)
    if not len(h):
        return sig.reshape(n_docs, m)
    _, first, count = np.unique(mix(h + mix(doc.astype(np.uint64) + np.uint64(1))), return_index=True, return_counts=True)
    doc, h = doc[first], h[first]
    bands = np.frompyfunc(lambda c: int(c - 1).bit_length() + 1, 1, 1)(count).astype(np.int64) if count.max() > 1 else np.ones(len(h), np.int64)
    of = np.repeat(np.arange(len(h)), bands)
    k = np.arange(len(of)) - np.repeat(np.cumsum(bands) - bands, bands)
    low = np.where(k > 0, 1 << np.maximum(k - 1, 0), 0).astype(np.uint64)
    width = np.maximum(low, 1).astype(np.uint64)
    pdoc, limit, rate = doc[of], count[of].astype(np.uint64), width.astype(np.float64)
    seed = mix(h[of] + k.astype(np.uint64) * _BAND)
    time, step = np.zeros(len(of)), np.zeros(len(of), np.int64)
    processes = np.maximum(np.bincount(pdoc, minlength=n_docs), 1)
    chunk = 1 << np.clip(np.ceil(np.log2(m * (np.log(m) + 1) / processes)), 0, 9).astype(np.int64)

    def emit(p: np.ndarray, c: int) -> None:
        """The next c points of processes p."""
        j = step[p][:, None] + np.arange(1, c + 1)
        u = mix(seed[p][:, None] + j.astype(np.uint64) * _STEP)
        gaps = -np.log(((u >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32) / rate[p][:, None]
        gaps[:, 0] += time[p]
        t = np.cumsum(gaps, axis=1)
        time[p], step[p] = t[:, -1], step[p] + c
        slot = pdoc[p][:, None] * m + (u & np.uint64(m - 1)).astype(np.int64)
        level = low[p][:, None] + (u >> np.uint64(7) & np.uint64(0x1FFFFFF)) % width[p][:, None]
        good = np.flatnonzero(((t < best[slot]) & (level < limit[p][:, None])).ravel())
        t, slot, u = t.ravel()[good], slot.ravel()[good], u.ravel()[good]
        order = np.argsort(-t, kind="stable")
        best[slot[order]], sig[slot[order]] = t[order], u[order]

    while True:
        latest = best.reshape(n_docs, m).max(1)
        active = np.flatnonzero(time < latest[pdoc])
        if not len(active):
            return sig.reshape(n_docs, m)
        c = np.where(np.isinf(latest), chunk, 1)[pdoc[active]]
        for size in np.unique(c):
            emit(active[c == size], int(size))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, m = sig.shape
    s = sig.reshape(n, m // rows, rows)
    acc = np.zeros((n, m // rows), np.uint64)
    for i in range(rows):
        acc = mix(acc * np.uint64(3) + s[:, :, i])
    return mix(acc + np.arange(m // rows, dtype=np.uint64) * _BAND).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = utf8(batch.column(1))
        keys, bands, sketches = [], [], []
        for lo, hi in groups(off):
            part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            w = Words(part, o)
            d, h = shingles(w)
            sig = bag_minhash(d, h, hi - lo)
            b, short = band_keys(sig), (sig >> np.uint64(8)).astype(np.uint8)
            sketches += [x.tobytes() for x in short]
            for i in range(hi - lo):
                keys.append(_key(w, i, part[o[i] : o[i + 1]]))
                bands.append(b[i] if w.first[i + 1] > w.first[i] else b[i][:0])
        sizes = np.cumsum([0, *map(len, bands)])
        lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), lists, pa.array(sketches, pa.binary())], names=["doc_id", "key", "bands", "sketch"])
    tidy()


def _key(w: Words, i: int, text: np.ndarray) -> bytes:
    """A digest of document i's words, or of its bytes if it has none."""
    a, z = w.first[i], w.first[i + 1]
    return hashlib.blake2b(w.hash[a:z].tobytes() if z > a else b"\0" + text.tobytes(), digest_size=16).digest()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = utf8(batch.column(1))
        out, keys = [], []
        for lo, hi in groups(off):
            part, o = buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            w = Words(part, o)
            keys += [_key(w, i, part[o[i] : o[i + 1]]) for i in range(hi - lo)]
            d, h = shingles(w)
            h = (h >> np.uint64(32)).astype(np.uint32)
            order = np.lexsort((h, d))
            d, h = d[order], h[order]
            cut = np.searchsorted(d, np.arange(hi - lo + 1))
            out += [h[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], names=["id", "key", "g"])
    tidy()


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two sorted multisets of 32-bit hashes."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    ux, cx = np.unique(x, return_counts=True)
    uy, cy = np.unique(y, return_counts=True)
    at = np.minimum(np.searchsorted(uy, ux), len(uy) - 1)
    both = int(np.minimum(cx, cy[at])[uy[at] == ux].sum())
    return both / (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sims = [overlap(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])


def _sketches(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), SLOTS)


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity estimated from sketches: 8 bits of each slot, so unlike slots agree once in 256."""
    return ((x == y).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _block_links(similar: float):
    """Verified pairs of two blocks of a bucket, as far as they join sets that differ. A pair is looked at in the first bucket it
    shares, likeliest pairs first, and not if pairs found before in the same two blocks already join its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            for bucket, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                (ix, lx, sx, bx, gx), (iy, ly, sy, by, gy) = _block(x.values), _block(y.values)
                est = np.stack([agreement(row, sy) for row in sx])
                able = (est >= similar - MARGIN) & (lx[:, None] != ly)
                if np.array_equal(ix, iy):
                    able &= ix[:, None] < iy
                i, j = np.nonzero(able)
                same = bx[i] == by[j]
                here = bx[i, same.argmax(1)] == bucket
                i, j = i[here], j[here]
                root: dict[int, int] = {}

                def find(k: int, root: dict[int, int] = root) -> int:
                    while (up := root.get(k, k)) != k:
                        root[k] = root.get(up, up)
                        k = up
                    return k

                for k in np.argsort(-est[i, j], kind="stable"):
                    p, q = find(int(lx[i[k]])), find(int(ly[j[k]]))
                    if p != q and (sim := overlap(gx[i[k]], gy[j[k]])) >= similar:
                        root[max(p, q)] = min(p, q)
                        out.append((int(ix[i[k]]), int(iy[j[k]]), sim))
            a, b, sims = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    return run


def _block(m: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    ids, labels, sketches, bands, grams = m.flatten()
    return ids.to_numpy(), labels.to_numpy(), _sketches(sketches), bands.flatten().to_numpy().reshape(len(ids), -1), grams.to_pylist()


# ---- links and components -------------------------------------------------------------------------------------
def components(edges: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each linked set, for ids with links; by alternating star contraction, until every
    id hangs on one root."""
    e = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        n, ids = e.agg(F.count("*"), F.count_distinct("a")).first()
        if n == ids and e.join(e.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("label"))
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        e = durable(small.distinct())


class Links:
    """Signatures, candidates, verified pairs and classes of a table of documents."""

    def __init__(self, docs: DataFrame, similar: float = SIMILAR):
        self.spark = docs.sparkSession
        small_batches(self.spark)
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
        self.similar = similar
        self.signed = durable(self.docs.mapInArrow(_signed, "doc_id long, key binary, bands array<long>, sketch binary"))
        self.members = self.signed.groupBy("key").agg(F.min("doc_id").alias("id"))
        self.edges, self.labels = self._link()

    def _link(self) -> tuple[DataFrame, DataFrame]:
        # A row for each text of an id: rows of one doc_id may hold several, and each keeps its bands, sketch and shingles.
        own = self.members.join(self.signed.where(F.size("bands") > 0), "key").where("id = doc_id").select("id", "key", "bands", "sketch").dropDuplicates(["id", "key"])
        own = durable(own)
        one = own.select("id", F.explode("bands").alias("bucket"))
        shared = one.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("c")).where("n > 1")
        many = durable(one.join(shared, "bucket"))  # bucket, id, n, c
        need = durable(many.select("id").distinct())
        n = need.count()
        few = F.broadcast(need) if n <= BROADCAST_IDS else need
        self.sketches = durable(own.join(few, "id", "left_semi").select("id", "key", "sketch"))
        picked = self.docs.join(few.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
        self.grams = durable(picked.mapInArrow(_grams, "id long, key binary, g binary").dropDuplicates(["id", "key"]))
        known = self._verify(self._alike(many.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()))
        nodes, same = need, self._same_id()
        if same is not None:
            known, nodes = known.union(same), need.union(same.select("a")).union(same.select("b")).distinct()
        labels = self._joined(nodes.withColumn("label", F.col("id")), known)
        now = durable(many.join(labels, "id"))
        split = now.groupBy("bucket").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("bucket")
        whole = self.grams.join(own, ["id", "key"])
        now = now.join(split, "bucket", "left_semi").join(whole, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
        blocks = durable(now.groupBy("bucket", "block").agg(F.collect_list(F.struct("id", "label", "sketch", "bands", "g")).alias("m")))
        x, y = blocks.select("bucket", F.col("block").alias("i"), F.col("m").alias("x")), blocks.select("bucket", F.col("block").alias("j"), F.col("m").alias("y"))
        self.spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_ROWS))
        new = durable(x.join(y, "bucket").where("i <= j").select("bucket", "x", "y").mapInArrow(_block_links(self.similar), "a long, b long, sim double"))
        small_batches(self.spark)
        return known.union(new).where(F.col("sim") >= self.similar), self._joined(labels, new)

    def _same_id(self) -> DataFrame | None:
        """Links between the representatives of several texts that rows of one doc_id hold; None if each id has one text."""
        several = durable(self.signed.groupBy("doc_id").agg(F.min("key").alias("p"), F.max("key").alias("q")).where("p <> q").select("doc_id"))
        if several.isEmpty():
            return None
        m = durable(self.signed.select("doc_id", "key").join(several, "doc_id").join(self.members, "key").select("doc_id", "id").distinct())
        m = m.join(m.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id")
        return durable(m.where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("sim")).distinct())

    def _alike(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sketches leave room for the similarity."""
        a, b = self.sketches.select(F.col("id").alias("a"), F.col("sketch").alias("x")), self.sketches.select(F.col("id").alias("b"), F.col("sketch").alias("y"))
        least = self.similar - MARGIN

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.select([0, 1]).filter(pa.array(agreement(_sketches(batch.column(2)), _sketches(batch.column(3))) >= least))

        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")

    def _joined(self, labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """labels with the sets that linked pairs connect made one; only the labels' own graph is contracted."""
        a, b = labels.select(F.col("id").alias("a"), F.col("label").alias("la")), labels.select(F.col("id").alias("b"), F.col("label").alias("lb"))
        e = pairs.where(F.col("sim") >= self.similar).join(a, "a").join(b, "b").where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
        to = components(e).select(F.col("id").alias("label"), F.col("label").alias("to"))
        return durable(labels.join(to, "label", "left").select("id", F.coalesce("to", "label").alias("label")))

    def _verify(self, pairs: DataFrame) -> DataFrame:
        a, b = self.grams.select(F.col("id").alias("a"), F.col("g").alias("x")), self.grams.select(F.col("id").alias("b"), F.col("g").alias("y"))
        return durable(pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long, sim double"))

    def classes(self) -> DataFrame:
        """doc_id and class_id, the smallest doc_id of the linked set."""
        m = self.members.join(self.labels, "id", "left").select("key", F.coalesce("label", "id").alias("class_id"))
        return self.signed.select("doc_id", "key").join(m, "key").groupBy("doc_id").agg(F.min("class_id").alias("class_id"))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    return Links(docs, similar).classes()


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """docs with their own columns: of each class the rows of smallest id, which are one class's texts; of several such rows one stays:
    the first by all their columns as text. Rows without an id stay."""
    c = durable(classes(docs, similar))
    gone, rows = durable(c.where("class_id <> doc_id").select("doc_id")), docs.where("doc_id IS NOT NULL")
    twice = durable(rows.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_IDS else x
    left = docs.join(few(gone), "doc_id", "left_anti").select(docs.columns)
    if twice.isEmpty():
        return left
    again = left.join(few(twice), "doc_id", "left_semi").select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("r"))
    again = again.groupBy(F.col("r.doc_id").alias("id")).agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    return left.join(few(twice), "doc_id", "left_anti").select(docs.columns).unionByName(again.select(docs.columns))


def op8(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
