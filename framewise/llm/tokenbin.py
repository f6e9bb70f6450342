"""Token-ID output: patched frame-of-reference blocks.

Documents are dealt by ranges of doc_id (one shuffle of the texts), sorted, encoded, and written as shards; each
range is one or more shards and knows the ids before each shard in its range, so only one total per range (as many
as shuffle partitions) meets on the driver to give global starts.

Shard layout (little-endian): magic ``FWP1``; u32 documents, u64 ids, u32 blocks; u64 index of block starts
(blocks + 1, from the first block); i64 doc_id and u8 null flag and u32 length for each document; then blocks of 1024 ids: u32
minimum, u8 width, u16 exceptions, packed words (32 lanes of 32 values, ``width`` u32 words a lane), u16 positions
and u32 whole differences of the exceptions. The width is that of the 95th percentile of the differences to the minimum.
Shards are rows of a Parquet table in the shared folder, so Spark's committer makes each appear whole or not at all.

Defined cases: null text counts as empty (the end id alone); empty tables give no shard; rows of the same doc_id follow
each other by text; a null doc_id comes first; other columns are not looked at.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, groups, mix, small_batches, table, tidy, utf8

BLOCK, LANES, PERCENTILE = 1024, 32, 95
END = 2
SHARD_IDS = 1 << 21
#: Pieces whose ids a worker keeps, some 60 bytes each (it starts again beyond, up to those of one group more), and bytes of text of a group.
CACHE_WORDS, GROUP = 1_000_000, 1 << 22
MAGIC = b"FWP1"


# ---- codec ----------------------------------------------------------------------------------------------------
def _pack(v: np.ndarray, w: int) -> np.ndarray:
    """(blocks, 1024) values under 2**w to (blocks, 32 * w) words."""
    v = v.reshape(-1, 32, LANES)
    out = np.zeros((len(v), max(w, 1), LANES), np.uint32)
    for j in range(32 if w else 0):
        word, shift = divmod(j * w, 32)
        out[:, word] |= v[:, j] << np.uint32(shift)
        if shift + w > 32:
            out[:, word + 1] |= v[:, j] >> np.uint32(32 - shift)
    return out[:, :w].reshape(len(v), -1)


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    out = np.zeros((len(words), 32, LANES), np.uint32)
    words = words.reshape(len(words), w, LANES)
    mask = np.uint32((1 << w) - 1) if w < 32 else np.uint32(0xFFFFFFFF)
    for j in range(32 if w else 0):
        word, shift = divmod(j * w, 32)
        x = words[:, word] >> np.uint32(shift)
        if shift + w > 32:
            x = x | words[:, word + 1] << np.uint32(32 - shift)
        out[:, j] = x & mask
    return out.reshape(len(words), -1)


def encode_blocks(ids: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Blocks of ids and the offsets where they start (one more than blocks)."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return [], np.zeros(1, np.uint64)
    v = np.full(blocks * BLOCK, ids[-1], np.uint32)
    v[:n] = ids
    v = v.reshape(blocks, BLOCK)
    low = v.min(1)
    v = v - low[:, None]
    kth = BLOCK * PERCENTILE // 100 - 1
    high = np.partition(v, kth, axis=1)[:, kth]
    width = np.frompyfunc(int.bit_length, 1, 1)(high.astype(object)).astype(int)
    out: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        part = v[at]
        over = part > (np.uint32((1 << int(w)) - 1) if w < 32 else np.uint32(0xFFFFFFFF))
        packed = _pack(np.where(over, np.uint32(0), part), int(w))
        for k, b in enumerate(at):
            pos = np.flatnonzero(over[k])
            out[b] = struct.pack("<IBH", low[b], w, len(pos)) + packed[k].tobytes() + pos.astype("<u2").tobytes() + part[k, pos].astype("<u4").tobytes()
    return out, np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.uint64)


def decode_blocks(data: memoryview | bytes, starts: np.ndarray, n: int) -> np.ndarray:
    blocks = len(starts) - 1
    out = np.zeros((blocks, BLOCK), np.uint32)
    heads = [struct.unpack_from("<IBH", data, int(s)) for s in starts[:-1]]
    widths = np.array([h[1] for h in heads], int)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        size = LANES * int(w)
        words = np.stack([np.frombuffer(data, "<u4", size, int(starts[b]) + 7) for b in at]) if w else np.zeros((len(at), 0), np.uint32)
        out[at] = _unpack(words, int(w))
        for b in at:
            if x := heads[b][2]:
                p = int(starts[b]) + 7 + 4 * size
                out[b, np.frombuffer(data, "<u2", x, p)] = np.frombuffer(data, "<u4", x, p + 2 * x)
    out += np.array([h[0] for h in heads], np.uint32)[:, None]
    return out.reshape(-1)[:n]


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, starts = encode_blocks(ids)
    known = np.array([0 if x is None else x for x in doc_ids], "<i8")
    null = np.array([x is None for x in doc_ids], "u1")
    return b"".join([MAGIC, struct.pack("<IQI", len(doc_ids), len(ids), len(blocks)), starts.astype("<u8").tobytes(), known.tobytes(), null.tobytes(), lengths.astype("<u4").tobytes(), *blocks])


def unpack_shard(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a shard."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    docs, n, blocks = struct.unpack_from("<IQI", data, 4)
    p = 20
    starts = np.frombuffer(data, "<u8", blocks + 1, p)
    p += 8 * (blocks + 1)
    known = np.frombuffer(data, "<i8", docs, p).tolist()
    null = np.frombuffer(data, "u1", docs, p + 8 * docs)
    lengths = np.frombuffer(data, "<u4", docs, p + 9 * docs)
    ids = decode_blocks(data, starts + np.uint64(p + 13 * docs), n)
    return [None if x else k for k, x in zip(known, null)], lengths, ids


# ---- tokens ---------------------------------------------------------------------------------------------------
# Classes of bytes: 0 white space, 1 ASCII letter, 2 digit, 3 apostrophe, 4 other ASCII, 5 beyond ASCII.
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[65:91] = _KIND[97:123] = 1
_KIND[48:58] = 2
_KIND[39] = 3
_KIND[128:] = 5
#: Whether a token always ends between two kinds: at white space, around a digit, after a letter, and before a letter
#: that follows no apostrophe. Beyond ASCII nothing is assumed, as characters may combine.
_CUT = np.zeros((6, 6), bool)
_CUT[0, :] = _CUT[:, 0] = True
_CUT[2, 1:5] = _CUT[1:5, 2] = True
_CUT[1, 3:5] = _CUT[4, 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The lowest k bytes of a word of eight.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class WordTokenizer:
    """A lower-casing tokenizer that drops white space and splits letters, single digits and other signs apart,
    applied to each different piece once; pieces are cut only where one of its tokens ends whatever stands around.

    A piece of up to 16 bytes is known by its first and last eight bytes and its size, which are all of it; a longer one by a
    number that a dictionary gives its bytes. Both are compared in whole, so a clash of hashes costs time and no wrong id.

    ``__init__`` refuses files for which that doesn't hold on a probe text. With ``special``, texts that hold the string of an
    added token go through the library whole, which gives its id; without, the string is text like any other.
    """

    def __init__(self, path: str, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.encode_special_tokens = True
        self.added: list[tuple[str, bool]] = []
        self.numbers = 0
        self._forget()
        probe = "Ab cD\n 12x3 x's don't!? 'tis a'b !'s 1.5e é\tÉa! z-9'll \"we're\" <|endoftext|> Incomprehensibilities'll incomprehensibilitiez"
        if self.of.encode(probe, add_special_tokens=False).ids != self.encode(pa.array([probe]))[0].tolist():
            raise ValueError("this tokenizer doesn't split as assumed")
        if special:
            self.added = [(t.content, t.normalized) for t in self.of.get_added_tokens_decoder().values()]

    def _forget(self) -> None:
        """Known pieces: sorted hashes and the row of each; by row the key, and where its ids begin and how many they are."""
        self.long: dict[bytes, int] = {}
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.key, self.begin, self.size = np.zeros((3, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _pieces(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes, start, size and key (first eight bytes, last eight, size) of each piece, and where each text's pieces begin."""
        kind = _KIND[buf]
        cut = np.ones(len(buf), bool)
        if len(buf):
            cut[1:] = _CUT[kind[:-1], kind[1:]]
            cut[off[:-1][off[:-1] < len(buf)]] = True
        at = np.flatnonzero(cut)
        size = np.diff(np.append(at, len(buf)))
        first = np.searchsorted(at, off)
        solid = kind[at] != 0
        first = np.concatenate([[0], np.cumsum(solid)])[first]
        at, size = at[solid], size[solid]
        low = np.zeros(len(buf) + 16, np.uint8)
        low[8:-8] = _LOWER[buf]
        eight = np.ndarray((len(buf) + 9,), "<u8", low, strides=(1,))
        few = np.minimum(size, 8)
        key = np.stack([eight[at + 8] & _MASK[few], eight[at + size] & ~_MASK[8 - few], size.astype(np.uint64)])
        for i in np.flatnonzero(size > 16).tolist():
            b = low[at[i] + 8 : at[i] + 8 + size[i]].tobytes()
            n = self.long.get(b)
            if n is None:
                n = self.long[b] = self.numbers
                self.numbers += 1
            key[0, i], key[1, i] = n, 0
        return low[8:-8], at, size, key, first

    def _learn(self, h: np.ndarray, key: np.ndarray, words) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each of several different pieces begin, and how many they are; words(i) is the text of piece i."""
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            row = self.row[at]
            fresh = np.flatnonzero((self.hash[at] != h) | (self.key[:, row] != key).any(0))
        else:
            row, fresh = np.zeros(len(h), np.int32), np.arange(len(h))
        if len(fresh) and len(self.size) and len(self.size) + len(fresh) > CACHE_WORDS:  # start again: what is frequent comes back soon
            self._forget()
            return self._learn(h, key, words)
        if len(fresh):
            sizes = []
            for i in range(0, len(fresh), 4096):
                got = [e.ids for e in self.of.encode_batch_fast([words(j) for j in fresh[i : i + 4096].tolist()], add_special_tokens=False)]
                sizes += map(len, got)
                flat = np.fromiter(chain.from_iterable(got), np.uint32)
                while self.used + len(flat) > len(self.flat):
                    self.flat = np.append(self.flat, np.zeros_like(self.flat))
                self.flat[self.used : self.used + len(flat)] = flat
                self.used += len(flat)
            size = np.array(sizes, np.int32)
            row[fresh] = np.arange(len(self.size), len(self.size) + len(fresh))
            self.begin = np.append(self.begin, self.used - size[::-1].cumsum(dtype=np.int64)[::-1])
            self.size, self.key = np.append(self.size, size), np.append(self.key, key[:, fresh], axis=1)
            order = fresh[np.argsort(h[fresh])]
            to = np.searchsorted(self.hash, h[order])
            self.hash, self.row = np.insert(self.hash, to, h[order]), np.insert(self.row, to, row[order])
        return self.begin[row], self.size[row]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        held = np.zeros(len(texts), bool)
        for s, normalized in self.added:
            held |= pc.fill_null(pc.match_substring(texts, s, ignore_case=normalized), False).to_numpy(zero_copy_only=False)
        if not held.any():
            return self._encode(texts)
        ids, counts = self._encode(pc.if_else(pa.array(held), pa.scalar("", texts.type), texts))
        upto = np.concatenate([[0], np.cumsum(counts)])
        parts, at = [], 0
        self.of.encode_special_tokens = False
        for i in np.flatnonzero(held).tolist():
            got = self.of.encode(texts[i].as_py(), add_special_tokens=False).ids
            parts += [ids[at : upto[i]], np.array(got, np.uint32)]
            at, counts[i] = upto[i], len(got)
        self.of.encode_special_tokens = True
        return np.concatenate([*parts, ids[at:]]), counts

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = utf8(texts)
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for lo, hi in groups(off, GROUP):
            low, at, size, key, first = self._pieces(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            h = mix(key[0] * np.uint64(0x9E3779B97F4A7C15) + mix(key[1] + key[2] * np.uint64(0xC2B2AE3D27D4EB4F)))
            coded = pa.array(h).dictionary_encode()
            of = coded.indices.to_numpy()
            one = np.zeros(len(coded.dictionary), np.int64)
            one[of] = np.arange(len(of))
            if (key[:, one][:, of] != key).any():  # two pieces with one hash: leave these texts to the library
                got = [self.of.encode(low[off[d] - off[lo] : off[d + 1] - off[lo]].tobytes().decode(), add_special_tokens=False).ids for d in range(lo, hi)]
                ids.append(np.array(list(chain.from_iterable(got)), np.uint32))
                counts.append(np.array(list(map(len, got)), np.int64))
                continue
            begin, n = self._learn(h[one], key[:, one], lambda i, low=low, at=at, size=size, one=one: low[at[one[i]] : at[one[i]] + size[one[i]]].tobytes().decode())
            begin, n = begin[of], n[of]
            upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
            ids.append(self.flat[np.repeat(begin - upto[:-1], n) + np.arange(upto[-1])])
            counts.append(np.diff(upto[first]))
        return np.concatenate(ids), np.concatenate(counts)


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path, special=True)
    return _tokenizers[path]


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Batches put together up to about size bytes."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


SHARD = "part int, seq int, base long, n_docs long, n_ids long, payload binary"


def write_shards(docs: DataFrame, path: str, end: int = END, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode docs (doc_id, text) into a table of shards in the shared folder, in ascending doc_id order; returns it."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    names = [f.strip().split()[0] for f in SHARD.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        docs_, lens, ids, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, base, docs_, lens, ids, held
            row = [part, seq, base, len(docs_), held, pack_shard(docs_, np.concatenate(lens), np.concatenate(ids))]
            seq, base, docs_, lens, ids, held = seq + 1, base + held, [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=names)

        t = tokenizer(path)
        for table_ in _gathered(batches, GROUP):
            got, n = t.encode(table_.column(1))
            with_end = np.empty(len(got) + len(n), np.uint32)
            last = np.cumsum(n + 1) - 1
            gap = np.ones(len(with_end), bool)
            gap[last] = False
            with_end[gap], with_end[last] = got, end
            docs_ += table_.column(0).to_pylist()
            lens.append(n + 1)
            ids.append(with_end)
            held += len(with_end)
            if held >= shard_ids:
                yield flush()
        if docs_:
            yield flush()
        tidy()

    d = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return durable(d.mapInArrow(run, SHARD))


def read_shards(shards: DataFrame) -> DataFrame:
    """One row per document read back from the shards: doc_id, start, n_tokens, ids_crc32."""
    totals = sorted((r[0], r[1]) for r in shards.groupBy("part").agg(F.sum("n_ids")).collect())  # as many as partitions
    before, rows = 0, []
    for part, n in totals:
        rows.append((part, before))
        before += n
    starts = dict(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, base, payload = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                docs, n, ids = unpack_shard(payload)
                upto = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(upto[:-1] + (starts[part] + base)), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.select("part", "base", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9(spark, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return read_shards(write_shards(docs, public_tokenizers.path("word_bpe_49k.json")))
