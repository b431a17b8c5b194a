"""Byte-level text helpers that run inside tasks, on numpy arrays of a few hundred documents at a time.

Texts travel as UTF-8 bytes (NULL is empty).  Lower-casing A-Z and the word classes used here only
concern ASCII bytes, and every byte of a longer UTF-8 sequence is a word byte, so working on bytes
gives the same words as working on code points.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 17

_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
# Letters, digits and every byte outside ASCII, after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(text: str | Column = "text") -> Column:
    """Text as bytes, NULL as empty."""
    return F.coalesce((F.col(text) if isinstance(text, str) else text).cast("binary"), F.lit(b""))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled = 1
    while filled < n:
        step = np.uint64(pow(int(base), filled, 1 << 64))
        more = min(filled, n - filled)
        out[filled:filled + more] = out[:more] * step
        filled += more
    return out


_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLE: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept per worker process up to the longest text seen."""
    if len(_TABLE.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        _TABLE["up"], _TABLE["down"] = _powers(size, BASE), _powers(size, _INVERSE)
    return _TABLE["up"], _TABLE["down"]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` takes differences of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * up[:len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes in [start, end), the same wherever those bytes stand."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


class Words:
    """Words of concatenated documents: byte spans, hashes and each document's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray):
        mask = word_bytes[data]
        start, end = mask.copy(), mask.copy()
        if len(mask):
            start[1:] &= ~mask[:-1]
            end[:-1] &= ~mask[1:]
            inner = offsets[(offsets > 0) & (offsets < len(mask))]
            start[inner] |= mask[inner]
            end[inner - 1] |= mask[inner - 1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hash(prefix_hash(self.data), self.start, self.end)

    def doc(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)


def shingles(words: Words, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each run of ``size`` words; a shorter document is one run of all it has."""
    code = np.zeros(len(hashes), np.uint64)
    n = len(hashes)
    if n >= size:
        code[:n - size + 1] = hashes[:n - size + 1]
        for i in range(1, size):
            code[:n - size + 1] = mix(code[:n - size + 1]) + hashes[i:n - size + 1 + i]
    doc = words.doc()
    last = words.first[1:][doc] if n else doc
    whole = np.arange(n) + size <= last
    code, out_doc = mix(code[whole]), doc[whole]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for j, d in enumerate(short):
            value = np.uint64(words.count[d])
            for h in hashes[words.first[d]:words.first[d + 1]]:
                value = mix(np.array([value], np.uint64))[0] ^ h
            extra[j] = value
        code, out_doc = np.concatenate([code, mix(extra)]), np.concatenate([out_doc, short])
    return code, out_doc


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES
           ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, concatenated bytes, offsets): slices of at most ``limit`` bytes, or one longer document."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not len(column):
            continue
        wide = pa.types.is_large_binary(column.type)
        offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[
            column.offset:column.offset + len(column) + 1].astype(np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            lo = hi


def gathered(batches: Iterable[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small record batches joined to fewer."""
    kept: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        kept.append(batch)
        held += batch.num_rows
        if held >= rows:
            yield from pa.Table.from_batches(kept).combine_chunks().to_batches()
            kept, held = [], 0
    if kept:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


def n_buckets(df: DataFrame) -> int:
    """Some buckets for each shuffle partition, so buckets are added as the cluster's setting grows."""
    return max(1, 3 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bucket_of(code: np.ndarray, buckets: int) -> np.ndarray:
    return ((code >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Blobs:
    """Collects arrays of entries and gives one row of packed bytes for each bucket.

    Columns in ``planes`` hold the first byte of all entries, then the second byte, and so on; read them by ``unpack_planes``.
    Numbers of like size compress far better so.
    """

    def __init__(self, buckets: int, names: list[str], limit: int = 600_000, planes: Collection[str] = ()):
        self.buckets, self.names, self.limit, self.planes = buckets, names, limit, planes
        self.parts: list[list[np.ndarray]] = []
        self.held = 0

    def add(self, bucket: np.ndarray, *arrays: np.ndarray) -> None:
        # Views would hold on to what they were cut from.
        self.parts.append([bucket.astype(np.int32), *(np.ascontiguousarray(x) for x in arrays)])
        self.held += len(bucket)

    def full(self) -> bool:
        return self.held >= self.limit

    def take(self) -> pa.RecordBatch | None:
        if not self.held:
            return None
        # One array at a time, whose sorted copy is what Arrow sends.
        columns = [list(x) for x in zip(*self.parts)]
        self.parts, self.held = [], 0
        bucket = np.concatenate(columns.pop(0))
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        edge = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(edge, len(bucket))
        out = [pa.array(bucket[edge])]
        for name in self.names:
            x = np.concatenate(columns.pop(0))
            row = x.nbytes // len(x)
            x = x[order]
            if name in self.planes:
                flat, x = x.view(np.uint8).reshape(len(x), row), np.empty(x.nbytes, np.uint8)
                for a, b in zip(edge, ends[1:]):
                    x[a * row:b * row].reshape(row, b - a)[:] = flat[a:b].T
            out.append(pa.Array.from_buffers(
                pa.binary(), len(edge), [None, pa.py_buffer((ends * row).astype(np.int32)), pa.py_buffer(x)]))
        return pa.RecordBatch.from_arrays(out, names=["bucket", *self.names])

    def schema(self) -> str:
        return "bucket int, " + ", ".join(f"{n} binary" for n in self.names)


def unpack(table: pa.Table, name: str, dtype) -> np.ndarray:
    """The arrays of all rows, one after another; NULL is an empty one.  The bytes are copied once at most."""
    joined = table.column(name).combine_chunks()
    if isinstance(joined, pa.ChunkedArray):  # over 2 GB
        return np.concatenate([np.frombuffer(x, dtype) for x in joined.to_pylist() if x] or [np.zeros(0, dtype)])
    if not len(joined) or joined.buffers()[2] is None:
        return np.zeros(0, dtype)
    edge = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(joined) + 1]
    first, last = int(edge[0]), int(edge[-1])
    return np.frombuffer(joined.buffers()[2], dtype, (last - first) // np.dtype(dtype).itemsize, first)


def unpack_planes(table: pa.Table, name: str, dtype) -> np.ndarray:
    """``unpack`` of a column that was sent in planes."""
    width = np.dtype(dtype).itemsize
    parts = [np.zeros(0, dtype)]
    for chunk in table.column(name).chunks:
        if not len(chunk) or chunk.buffers()[2] is None:
            continue
        edge = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset:chunk.offset + len(chunk) + 1].tolist()
        raw = np.frombuffer(chunk.buffers()[2], np.uint8)
        out = np.empty(((edge[-1] - edge[0]) // width, width), np.uint8)
        for a, b in zip(edge, edge[1:]):
            if a < b:
                out[(a - edge[0]) // width:(b - edge[0]) // width] = raw[a:b].reshape(width, -1).T
        parts.append(out.view(dtype).ravel())
    return np.concatenate(parts)
