"""Vectorised work on the bytes of many texts at once, shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# A fixed random number for each byte and a fixed odd multiplier; hashes depend on nothing else.
BYTE_CODES = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64)
STEP = 0x9E3779B97F4A7C15


@dataclass
class Texts:
    """Consecutive texts: their bytes end to end, and where each begins (and the last ends)."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Which text each byte position belongs to."""
        return np.searchsorted(self.offsets, positions, side="right") - 1


def texts_of(column: pa.Array, limit: int = 1 << 20) -> Iterator[Texts]:
    """The texts of an Arrow column in slices of about ``limit`` bytes; a longer text is a slice of its own.

    A null is an empty text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    if not n:
        return
    _, where, content = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(n, max(stop, at + 1))
        yield Texts(at, data[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
        at = stop


def word_bounds(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where the words ``[^\\x20\\x09-\\x0D]+`` of all texts begin and end, in order."""
    if not len(texts.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[texts.data]
    cut = np.ones(len(space) + 1, bool)
    cut[1:-1] = space[1:] | space[:-1]
    cut[texts.offsets] = True
    inside = ~space
    return np.flatnonzero(inside & (cut[:-1])), np.flatnonzero(inside & cut[1:]) + 1


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), STEP, np.uint64)], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``h`` (uint64, one to one)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def word_hashes(texts: Texts, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash for each word: a polynomial over byte codes, then mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    place = np.arange(total) - np.repeat(first, lengths)
    codes = LOWER[texts.data] if lower else texts.data
    values = BYTE_CODES[codes[place + np.repeat(starts, lengths)]]
    values *= powers(int(lengths.max()))[place]
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


class Packer:
    """Collects equally long columns by bucket and hands them out as one row of bytes per bucket.

    A row of bytes holds many entries, so a shuffle moves few rows. Entries are kept until
    ``limit`` of them are there.
    """

    def __init__(self, types: list, limit: int = 2_000_000):
        self.types, self.limit, self.held, self.count = [np.dtype(t) for t in types], limit, [], 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket.astype(np.int32), *[c.astype(t, copy=False) for c, t in zip(columns, self.types)]))
            self.count += len(bucket)
        if self.count >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        bucket, *columns = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.count = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        columns = [c[order] for c in columns]
        edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        rows = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges[:-1], edges[1:])]
        for at in range(0, len(rows), 256):
            yield pa.record_batch({
                "bucket": pa.array(bucket[edges[at:at + 257][:len(rows[at:at + 256])]], pa.int32()),
                "entries": pa.array(rows[at:at + 256], pa.binary()),
            })


PACKED = "bucket int, entries binary"


def unpack(rows: list[bytes], types: list) -> list[np.ndarray]:
    """The columns of packed rows, joined."""
    types = [np.dtype(t) for t in types]
    width = sum(t.itemsize for t in types)
    out: list[list[np.ndarray]] = [[] for _ in types]
    for row in rows:
        n, at = len(row) // width, 0
        for column, t in zip(out, types):
            column.append(np.frombuffer(row, t, n, at))
            at += n * t.itemsize
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, types)]


def buckets(batches: Iterator[pa.RecordBatch], key: str = "bucket", value: str = "entries"):
    """(bucket, rows) for rows that arrive sorted by bucket; one bucket is held at a time."""
    current, rows = None, []
    for batch in batches:
        for b, row in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
            if b != current:
                if rows:
                    yield current, rows
                current, rows = b, []
            rows.append(row)
    if rows:
        yield current, rows


def squeeze(*columns: np.ndarray) -> bytes:
    """Columns of any kind and length as compressed bytes; whole numbers of 8 bytes are kept as differences."""
    kinds, parts = [], []
    for c in columns:
        kinds.append(c.dtype.str.ljust(4))
        parts.append((np.diff(c, prepend=c.dtype.type(0)) if c.dtype == np.int64 else c).tobytes())
    head = np.array([len(columns), *[len(c) for c in columns]], np.int64).tobytes()
    body = head + "".join(kinds).encode() + b"".join(parts)
    return np.int64(len(body)).tobytes() + pa.Codec("zstd", compression_level=1).compress(body, asbytes=True)


def expand(blob: bytes) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.int64, 1)[0])
    body = pa.Codec("zstd").decompress(blob[8:], decompressed_size=size, asbytes=True)
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    at, out = 8 + 12 * n, []
    for k, size in enumerate(sizes.tolist()):
        kind = np.dtype(body[8 + 8 * n + 4 * k:8 + 8 * n + 4 * k + 4].decode().strip())
        column = np.frombuffer(body, kind, size, at)
        out.append(np.cumsum(column) if kind == np.int64 else column)
        at += size * kind.itemsize
    return out


class Parcels:
    """Like :class:`Packer`, with compressed rows: entries keep their order, so sorted ids take little room."""

    def __init__(self, limit: int = 4_000_000):
        self.limit, self.held, self.count = limit, [], 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(bucket):
            self.held.append((bucket.astype(np.int32), *columns))
            self.count += len(bucket)
        if self.count >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        bucket, *columns = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.count = [], 0
        order = np.argsort(bucket, kind="stable")
        bucket, columns = bucket[order], [c[order] for c in columns]
        edges = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        yield parcel_rows(
            bucket[edges[:-1]], [squeeze(*[c[a:b] for c in columns]) for a, b in zip(edges[:-1], edges[1:])])


def parcel_rows(names, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"bucket": pa.array(names, pa.int32()), "entries": pa.array(blobs, pa.binary())})


def open_parcels(rows: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*[expand(row) for row in rows])]


def deflated(column: pa.Array) -> pa.Array:
    """Each text compressed by itself; a null as an empty text."""
    codec = pa.Codec("zstd", compression_level=3)
    return pa.array([
        len(t).to_bytes(8, "little") + codec.compress(t, asbytes=True)
        for t in column.fill_null("").cast(pa.binary()).to_pylist()], pa.binary())


def inflated(column: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd")
    return pa.array([
        codec.decompress(t[8:], decompressed_size=int.from_bytes(t[:8], "little"), asbytes=True)
        for t in column.to_pylist()], pa.binary())
