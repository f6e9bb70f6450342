"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against the documents' token windows.

A word is a run of ``a-z``, ``0-9`` and characters beyond ASCII after lower-casing A-Z. A window is ten consecutive
words of a benchmark item; an item of one to nine words is one window of that length. Documents are scanned in one
pass without a shuffle: a rolling hash of each run of words is looked up in the set, and each hit is confirmed by
comparing the words themselves.

Size of the broadcast: the benchmark's text is measured first. Up to ``slice_bytes`` (default 16 MB, an index of some 64 MB) it is one
set; a larger one is dealt into slices of that size by a hash of the item id, each slice is one pass over the
documents, and the passes' rows are merged by a row id. So no set beyond the bound is ever broadcast and
nothing is dropped.

Defined cases: null text has no words (0 words, no hit); empty documents or benchmark give no hits; repeated
documents are judged one by one; repeated item ids count once; a null item id is written ``null``; other columns of
either table are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, durable, groups, small_batches, utf8

N = 10
#: Text of a benchmark slice. An index holds some 4 bytes for each of its bytes (20 a window, and the words themselves).
SLICE_BYTES = 16 << 20
BITS = 20


class Index:
    """Windows of benchmark items: by length their sorted hashes behind a bitmap, and of each where its words stand in the items' text."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N):
        buf, off = utf8(pa.array([t for _, t in items], pa.string()))
        self.names = [name for name, _ in items]
        parts: dict[int, list[tuple[np.ndarray, ...]]] = {}
        texts, base = [], 0
        for lo, hi in groups(off):
            w = Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            size = w.ends - w.starts + 1  # words one space apart
            end = base + np.cumsum(size)
            at = np.repeat(end - size - w.starts, size - 1) + np.repeat(w.starts, size - 1) + _within(size - 1)
            text = np.full(int(size.sum()), 32, np.uint8)
            text[at - base] = w.low[np.repeat(w.starts, size - 1) + _within(size - 1)]
            texts.append(text)
            words = np.diff(w.first)
            for k in np.unique(np.minimum(words[words > 0], n)).tolist():
                i, h = w.windows(k)
                some = np.minimum(words[w.doc[i]], n) == k
                i, h = i[some], h[some]
                parts.setdefault(k, []).append((h, lo + w.doc[i], end[i] - size[i], end[i + k - 1] - 1))
            base = int(end[-1]) if len(end) else base
        self.text = np.concatenate([np.zeros(0, np.uint8), *texts])
        self.hashes: dict[int, np.ndarray] = {}
        self.where: dict[int, tuple[np.ndarray, ...]] = {}
        self.bitmap: dict[int, np.ndarray] = {}
        for k, found in parts.items():
            h, doc, a, z = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(h, kind="stable")
            self.hashes[k], self.where[k] = h[order], (doc[order].astype(np.int32), a[order].astype(np.int32), (z - a)[order].astype(np.int32))
            self.bitmap[k] = np.zeros(1 << BITS, bool)
            self.bitmap[k][h >> np.uint64(64 - BITS)] = True

    def items(self, k: int, h: np.uint64, words: bytes) -> set[str]:
        """The items that hold these k words, whose window has hash h."""
        doc, start, size = self.where[k]
        lo, hi = np.searchsorted(self.hashes[k], h, "left"), np.searchsorted(self.hashes[k], h, "right")
        return {self.names[doc[i]] for i in range(lo, hi) if size[i] == len(words) and self.text[start[i] : start[i] + size[i]].tobytes() == words}

    def hits(self, w: Words) -> Iterator[tuple[int, int, set[str]]]:
        """First word, length and items of each window that occurs."""
        for k, known in self.hashes.items():
            at, h = w.windows(k)
            some = np.flatnonzero(self.bitmap[k][h >> np.uint64(64 - BITS)])
            at, h = at[some], h[some]
            near = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h
            seen: dict[int, tuple[bytes, set[str]]] = {}
            for i, x in zip(at[near].tolist(), h[near].tolist()):
                words = w.text(i, k)
                got = seen.get(x)
                if got is None or got[0] != words:
                    got = seen[x] = words, self.items(k, np.uint64(x), words)
                if got[1]:
                    yield i, k, got[1]


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each size, end to end."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def scan(docs: DataFrame, index: Index) -> DataFrame:
    """Per document: words, the byte ranges of hit words (merged per run), hit words and items."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    keep = [f for f in docs.schema.fields if f.name not in ("text",)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", _n_words long, _hit array<long>, _spans array<long>, _items array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            n = len(off) - 1
            n_words, hit, spans, items = np.zeros(n, np.int64), [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            for lo, hi in groups(off):
                w = Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                n_words[lo:hi] = np.diff(w.first)
                by: dict[int, tuple[set[int], set[str]]] = {}
                for i, k, found in held.value.hits(w):
                    words, names = by.setdefault(int(w.doc[i]), (set(), set()))
                    words.update(range(i, i + k))
                    names.update(found)
                for d, (words, names) in by.items():
                    at = np.array(sorted(words))
                    hit[lo + d] = (at - w.first[d]).tolist()
                    edge = np.flatnonzero(np.diff(at) > 1)
                    a, b = at[np.r_[0, edge + 1]], at[np.r_[edge, len(at) - 1]]
                    spans[lo + d] = np.stack([w.starts[a], w.ends[b]], 1).ravel() - w.off[d]
                    items[lo + d] = sorted(names)
            cols = [batch.column(f.name) for f in keep] + [pa.array(n_words), pa.array(hit, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in keep] + ["_n_words", "_hit", "_spans", "_items"])

    return docs.mapInArrow(run, schema)


def n_slices(bench: DataFrame, slice_bytes: int | None = None) -> int:
    """The number of parts of about slice_bytes (default SLICE_BYTES) of the benchmark's text."""
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // (slice_bytes or SLICE_BYTES)))


def slices(bench: DataFrame, k: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in k parts."""
    b = bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    for i in range(k):
        yield [tuple(r) for r in (b if k == 1 else b.where(F.pmod(F.xxhash64("item"), F.lit(k)) == i)).collect()]


def matches(docs: DataFrame, bench: DataFrame, n: int = N, slice_bytes: int | None = None) -> DataFrame:
    """docs without text, with _n_words, _hit (words), _spans (byte ranges of hit runs) and _items."""
    small_batches(docs.sparkSession)
    k = n_slices(bench, slice_bytes)
    if k > 1:  # rows of one document, and of none, must stay apart while passes are merged
        docs = durable(docs.select(F.expr("uuid()").alias("_row"), *[F.col(f"`{c}`") for c in docs.columns]))
    parts = [scan(docs, Index(part, n)) for part in slices(bench, k)]
    if k == 1:
        return parts[0]
    return _merged(parts, [c for c in docs.columns if c != "text"]).drop("_row")


def _merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = {c: F.first(c).alias(c) for c in keys[1:]}
    return out.groupBy(keys[0]).agg(
        *first.values(),
        F.max("_n_words").alias("_n_words"),
        F.array_distinct(F.flatten(F.collect_list("_hit"))).alias("_hit"),
        F.flatten(F.collect_list("_spans")).alias("_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_items")))).alias("_items"),
    )


def report(docs: DataFrame, bench: DataFrame, n: int = N, slice_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    m = matches(docs.select("doc_id", "text"), bench, n, slice_bytes)
    return m.select(
        "doc_id",
        F.col("_n_words").alias("n_words"),
        F.size("_hit").cast("long").alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        (F.size("_hit") > 0).alias("contaminated"),
    )


def _without(text: str | None, spans: list[int]) -> str | None:
    if text is None or not len(spans):
        return text
    data, out, at = text.encode(), [], 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        out.append(data[at : max(at, a)])
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode()


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "documents", n: int = N, slice_bytes: int | None = None) -> DataFrame:
    """docs with their own columns, without the documents that hold a benchmark window (remove="documents"), or
    with the hit words cut out of their texts (remove="spans"). One pass for each slice of the benchmark, all in one stage; only texts
    go to Python, rows stay in the JVM."""
    spark = docs.sparkSession
    small_batches(spark)
    spans, found = F.array().cast("array<bigint>"), F.lit(False)
    for part in slices(bench, n_slices(bench, slice_bytes)):
        here = _hit_ranges(spark.sparkContext.broadcast(Index(part, n)))
        if remove == "spans":
            spans = F.concat(spans, here)
        else:
            found = found | (F.size(here) > 0)
    if remove != "spans":
        return docs.where(~found)

    def trim(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([_without(x, y) for x, y in zip(texts.to_pylist(), spans.to_pylist())], pa.string())

    return docs.withColumn("text", F.arrow_udf(trim, "string")(F.col("text"), spans))


def _hit_ranges(held) -> Column:  # noqa: ANN001
    def ranges(texts: pa.Array) -> pa.Array:
        return pa.array(_byte_spans(texts, held.value), pa.list_(pa.int64()))

    return F.arrow_udf(ranges, "array<bigint>")(F.col("text"))


def _byte_spans(texts: pa.Array, index: Index) -> list[list[int]]:
    """Of each text the byte ranges of its hits, start and end in turn."""
    buf, off = utf8(texts)
    out: list[list[int]] = [[] for _ in range(len(off) - 1)]
    for lo, hi in groups(off):
        w = Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        for i, k, _ in index.hits(w):
            d = int(w.doc[i])
            out[lo + d] += (int(w.starts[i] - w.off[d]), int(w.ends[i + k - 1] - w.off[d]))
    return out


def op10(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM t, ks WHERE len(w) >= k)),
h AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw ON dw.g = bw.g AND dw.k = bw.k),
hw AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
hi AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM h GROUP BY r)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(hi.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM t LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
"""
