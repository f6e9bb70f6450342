"""Shared pieces of the training-data operators: table access, durable cuts, Arrow and byte handling."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

#: Rows of one Arrow batch; with texts of a few kB a batch is a few MB.
BATCH_ROWS = 512
#: Bytes of text handled by numpy at once; a longer document is a group of its own.
GROUP_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches, and this package on the executors."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one of this machine only where none is set and the driver is the only machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="framewise-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def durable(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/framewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Give memory that a finished task freed back to the system: a worker process lives on for other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU library
        pass


def unlike(columns: list[str], *names: str) -> list[str]:
    """names, each behind as many underscores as make all of them differ from the columns, whatever their case."""
    taken, mark = {c.lower() for c in columns}, "_"
    while any(mark + n in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


_written: list[str] = []


def discard(spark: SparkSession) -> int:
    """Delete the tables that ``durable`` has written so far; call it when no DataFrame that reads them is needed any more."""
    jvm, n = spark.sparkContext._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return n


def uniform(col: Column, salt: str) -> Column:
    """A number in [0, 1) from md5 of the value as text; the same in any SQL engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt + ":"), col.cast("string"))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array end to end and the offsets of its values (null: empty)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    n = len(arr)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * arr.offset) if n else np.zeros(1, np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def groups(off: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold up to limit bytes together, or one longer document."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


# ---- words of bytes -------------------------------------------------------------------------------------------
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
_P = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _pow or len(_pow[0]) < n:
        n = max(n, GROUP_BYTES + 1)
        _pow[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (_P, pow(_P, -1, 2**64))]
    return _pow[0], _pow[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (one-to-one)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of several documents: runs of a-z, 0-9 and characters beyond ASCII after lower-casing A-Z.

    low: lower-cased bytes; starts, ends: byte range of each word; first: index of each document's first word,
    and the number of words; hash: 64 bits of each word.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.low = low = _LOW[buf]
        n = len(low)
        self.off = off
        inside = _WORD[low]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            cut = off[:-1][off[:-1] < n]
            begins[cut] = inside[cut]
            cut = off[1:][off[1:] > 0] - 1
            ends[cut] = inside[cut]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, off)
        power, back = _powers(n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(_VALUE[low] * power[:n], out=total[1:])
        self.hash = mix((total[self.ends] - total[self.starts]) * back[self.starts])
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of each run of n words of one document."""
        m = len(self.hash) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc, q = np.zeros(m, np.uint64), 1
        for j in range(n):
            acc += self.hash[j : j + m] * np.uint64(q)
            q = q * 0xC2B2AE3D27D4EB4F % 2**64
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1 :])
        return at, mix(acc[at] + np.uint64(n))

    def text(self, i: int, n: int) -> bytes:
        return b" ".join(self.low[s:e].tobytes() for s, e in zip(self.starts[i : i + n], self.ends[i : i + n]))
