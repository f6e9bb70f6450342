"""Exact top-k by inner product with a pivot table.

Each component x becomes floor(64 * x). For vectors of integers, q.x = (|q|^2 + |x|^2 - d(q,x)^2) / 2, and every pivot p
bounds the distance from below, d(q,x) >= |d(q,p) - d(x,p)|; the largest over the pivots bounds the score from above.
Distances of candidates to the pivots are computed once per batch of candidates; a query takes candidates in the order of
their bounds and stops when the next bound is under its k-th score, so results are exact whatever the pivots.

Pivots: ``PIVOTS`` vectors picked far apart (greedy, farthest first) from a bounded sample of ``SAMPLE`` vectors. Queries
are broadcast in chunks of at most about ``CHUNK_BYTES``; each chunk is one pass over the candidates, which never move. A
partition sends the best k of each query, and these are ranked by query.

Defined cases: vectors null, empty, or holding null or non-finite components take no part; a shorter vector counts as padded by
zeros; ties go to the smaller vec_id; rows of the same vec_id are separate candidates, and a query excludes rows of its own id;
a query id in several rows is each of them, ranked together; empty tables give none; other columns aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, table

K, EVERY, PIVOTS, SAMPLE, BATCH, TAKE = 20, 20, 32, 1000, 8192, 512
#: Bytes of a chunk of queries (8 a component), whatever the vectors' width.
CHUNK_BYTES = 32 << 20


def usable(e: Column) -> Column:
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return e.isNotNull() & (F.size(e) > 0) & ~bad


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """(rows, dim) integers as doubles, padded by zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    off = col.offsets.to_numpy()
    size = np.diff(off)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(off[:-1] - off[0], size)] = np.floor(64.0 * flat)
    return out


def pick_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Rows of x far apart: each the farthest from those before it."""
    if not len(x):
        return x
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T, 0))


class Search:
    """The best k of each query so far, as candidates come in batches."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.q, self.pivots, self.k = ids, q, pivots, k
        self.norm, self.table = (q * q).sum(1), distances(q, pivots)
        self.best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        self.floor = np.full(len(q), -np.inf)
        self.evaluated = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        norm, to = (x * x).sum(1), distances(x, self.pivots).T.copy()
        order_norm = norm[None]
        for a in range(0, len(self.q), 64):
            bound = np.zeros((len(self.q[a : a + 64]), len(x)))
            for p in range(len(self.pivots)):
                np.maximum(bound, np.abs(self.table[a : a + 64, p, None] - to[p]), out=bound)
            bound = (self.norm[a : a + 64, None] + order_norm - bound * bound) / 2 * (1 + 1e-12) + 1e-3
            for i in range(len(bound)):
                self._take(a + i, bound[i], ids, x)

    def _take(self, i: int, bound: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        able = np.flatnonzero((bound >= self.floor[i]) & (ids != self.ids[i]))
        able = able[np.argsort(-bound[able], kind="stable")]
        size = TAKE
        while len(able):
            now, able = able[:size], able[size:]
            size *= 2
            score = x[now] @ self.q[i]
            self.evaluated += len(now)
            some = score >= self.floor[i]
            s, v = np.concatenate([self.best[i][0], score[some]]), np.concatenate([self.best[i][1], ids[now][some]])
            order = np.lexsort((v, -s))[: self.k]
            self.best[i] = s[order], v[order]
            if len(order) == self.k:
                self.floor[i] = s[order[-1]]
                able = able[bound[able] >= self.floor[i]]


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, pivots: int = PIVOTS, chunk: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k best other rows."""
    spark = vectors.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL").where(usable(F.col("embedding")))
    dim, queries = v.agg(F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.count_if(F.col("vec_id") % every == 0)).first()
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    base = pick_pivots(matrix(sample["embedding"], dim) if sample.num_rows else np.zeros((0, dim)), pivots)
    parts, n = None, max(1, -(-queries // (chunk or max(1, CHUNK_BYTES // (8 * dim)))))
    for i in range(n):
        q = v.where(F.col("vec_id") % every == 0).where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).orderBy("vec_id").toArrow()
        ids, x = (q["vec_id"].to_numpy(), matrix(q["embedding"], dim)) if q.num_rows else (np.zeros(0, np.int64), np.zeros((0, dim)))
        held = spark.sparkContext.broadcast((ids, x, base))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            search = Search(*held.value, k)
            for batch in batches:
                search.add(batch.column(0).to_numpy(), matrix(batch.column(1), dim))
            sizes = [len(s) for s, _ in search.best]
            if sum(sizes):
                cols = [np.repeat(search.ids, sizes), np.concatenate([b for _, b in search.best]), np.concatenate([s for s, _ in search.best]).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

        part = v.mapInArrow(run, "query_id long, vec_id long, score long")
        parts = part if parts is None else parts.unionByName(part)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM q JOIN v ON q.vec_id <> v.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
