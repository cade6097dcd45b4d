"""Removal of byte strings that an earlier document holds, by a logarithmic family of suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that also starts in a document with a smaller id. All
strings are judged on the input.

Where suffixes are kept. Each window of ``length`` bytes picks the smallest hash of the ``GRAM``-byte strings in it.
Equal windows pick equal hashes, so a hash that one document holds alone rules out all windows that picked it. The
rest, spans of windows with one hash, are dealt over buckets by that hash: any two equal windows meet in one bucket.
A hash that more than ``HOT`` spans picked would fill its bucket. Its spans are cut into single windows, which are dealt
by their own hash: equal windows still meet, and the spans of one hash spread over all buckets.

Only 32 bits of a hash travel: a bucket holds about as many whatever the input, and a chance agreement costs work, not
results. Texts are shuffled once, compressed, and read twice.

In a bucket, spans come in order of document. Batches of their windows, each the first ``length`` bytes of a suffix,
get a suffix array; it is merge-scanned against the levels that exist, and what no level holds becomes the lowest
level. Levels of one size class are merged, so there are logarithmically many, and each suffix is
merged logarithmically often. Spans that repeat whole are settled by their first document, before the shuffle where
they meet in a task and in the bucket otherwise, so a passage that very many documents share
costs one entry per task.

Nulls are empty texts. A document without an id removes nothing and loses nothing. Rows that repeat an id do not act
on each other. An empty table gives an empty result; columns not asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.spark import bucket_count, by_bucket
from plumbline.llm.texts import (
    BYTE_CODES, PACKED, STEP, Parcels, Texts, buckets, deflated, inflated, open_parcels, parcel_rows, squeeze, texts_of,
)

LENGTH = 50
GRAM = 28
# Text bytes whose suffixes one bucket holds, and windows that make a batch.
PER_BUCKET = 8 << 20
BATCH = 1 << 17
SLICE = 1 << 18
# Spans of one hash that one bucket holds; those of others are dealt by window, so many windows at a time.
HOT = 1 << 14
CUT = 1 << 18


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of many ranges, end to end."""
    first = np.cumsum(lengths) - lengths
    return data[np.arange(int(lengths.sum())) + np.repeat(starts - first, lengths)]


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """The hash of the ``n`` bytes from each position on, built from those of 1, 2, 4 ... bytes."""
    part, size, whole, done = BYTE_CODES[data], 1, None, 0
    while True:
        if n & size:
            # ``whole`` covers the first ``done`` bytes; append this power of two.
            if whole is None:
                whole = part
            else:
                m = len(part) - done
                whole = whole[:m] * np.uint64(pow(STEP, size, 1 << 64)) + part[done:done + m]
            done += size
        if size * 2 > n:
            break
        part = part[:-size] * np.uint64(pow(STEP, size, 1 << 64)) + part[size:] if len(part) > size else part[:0]
        size *= 2
    whole = whole[:max(0, len(data) - n + 1)]
    whole = whole ^ (whole >> np.uint64(29))
    return whole * np.uint64(0xBF58476D1CE4E5B9)


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:len(values) - (n - size)], values[n - size:]) if n > size else values


def window_runs(texts: Texts, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, count, hash) of each run of window starts that pick one hash."""
    none = np.zeros(0, np.int64)
    if len(texts.data) < length:
        return none, none, none, none.astype(np.uint64)
    picked = sliding_min(gram_hashes(texts.data, gram), length - gram + 1)
    place = np.arange(len(picked))
    sizes = np.diff(texts.offsets)
    valid = (np.repeat(texts.offsets[1:], sizes)[:len(picked)] - place) >= length
    new = valid.copy()
    new[1:] &= (picked[1:] != picked[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    start, stop = np.flatnonzero(new), np.flatnonzero(last) + 1
    return texts.owner(start), start, stop - start, picked[start]


def ids_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and which rows have one."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def text_key(text: bytes) -> int:
    """Tells texts of one id apart."""
    return xxhash.xxh64_intdigest(text)


class SuffixFamily:
    """Sorted arrays of distinct suffixes with the first document of each; levels at least double in size."""

    def __init__(self, length: int):
        self.length = length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """The smallest document holding each window, of this batch and all before; docs never decrease."""
        order = np.argsort(windows, kind="stable")
        ordered = windows[order]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        suffixes, first = ordered[new], docs[order][new]
        known = np.zeros(len(suffixes), bool)
        for held, owners in self.levels:
            at = np.searchsorted(held, suffixes)
            at[at == len(held)] = 0
            hit = held[at] == suffixes
            first = np.where(hit, np.minimum(first, owners[at]), first)
            known |= hit
        out = np.empty(len(windows), docs.dtype)
        out[order] = first[np.cumsum(new) - 1]
        if not known.all():
            self.levels.append((suffixes[~known], first[~known]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            (a, own_a), (b, own_b) = self.levels.pop(), self.levels.pop()
            both = np.concatenate([b, a])
            order = np.argsort(both, kind="stable")
            self.levels.append((both[order], np.concatenate([own_b, own_a])[order]))
        return out


def covered_ranges(
    fixed: list[np.ndarray], spans: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, start, end) of bytes to remove, from all spans of one bucket.

    ``fixed`` holds doc, key, position, size and whether the span is settled; ``spans`` the bytes of the others.
    """
    doc, key, at, size, settled = fixed
    done = settled.astype(bool)
    out = [(doc[done], key[done], at[done], at[done] + size[done])]
    if not done.all():
        doc, key, at, size = (x[~done] for x in (doc, key, at, size))
        size = size.astype(np.int64)
        first = np.cumsum(size) - size
        content = content_hashes(spans, first, size)
        order = np.lexsort((doc, size, content))
        c, s = content[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        lead = doc[order][new][group]
        later = doc[order] > lead
        whole = order[later]
        out.append((doc[whole], key[whole], at[whole], at[whole] + size[whole].astype(np.uint32)))
        # Spans of the first document of their kind: one copy of each goes through the family.
        kinds = order[new]
        kinds = kinds[np.argsort(doc[kinds], kind="stable")]
        family = SuffixFamily(length)
        kind_of = np.empty(new.sum(), np.int64)
        kind_of[group[np.argsort(order)][kinds]] = np.arange(len(kinds))
        windows = size[kinds] - (length - 1)
        ends = np.cumsum(windows)
        found: list[np.ndarray] = []
        begin = 0
        while begin < len(kinds):
            base = ends[begin] - windows[begin]
            stop = max(begin + 1, int(np.searchsorted(ends, base + BATCH, side="right")))
            chosen = kinds[begin:stop]
            n = windows[begin:stop]
            starts = np.arange(int(n.sum())) + np.repeat(first[chosen] - (np.cumsum(n) - n), n)
            view = np.lib.stride_tricks.sliding_window_view(spans, length)[starts]
            suffixes = np.ascontiguousarray(view).view(f"S{length}").ravel()
            owners = np.repeat(doc[chosen], n)
            found.append(family.add(suffixes, owners) < owners)
            begin = stop
        hit = np.concatenate(found)
        # Every row of the first document of a kind shares the outcome of that kind.
        same = order[~later]
        kind = kind_of[group[~later]]
        n = windows[kind]
        flat = hit[np.arange(int(n.sum())) + np.repeat((ends - windows)[kind] - (np.cumsum(n) - n), n)]
        edge = np.zeros(len(flat) + 1, bool)
        edge[np.cumsum(n) - n] = True
        edge[-1] = True
        begins = np.flatnonzero(flat & (edge[:-1] | ~np.r_[False, flat[:-1]]))
        stops = np.flatnonzero(flat & (edge[1:] | ~np.r_[flat[1:], False])) + 1
        row = np.searchsorted(np.cumsum(n), begins, side="right")
        offset = (np.cumsum(n) - n)[row]
        rows = same[row]
        out.append((doc[rows], key[rows], at[rows] + (begins - offset).astype(np.uint32),
                    at[rows] + (stops - offset + length - 1).astype(np.uint32)))
    return tuple(np.concatenate(x) for x in zip(*out))


def content_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each range, by another function than the one that picks windows."""
    raw = data.tobytes()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:a + n]) for a, n in zip(starts.tolist(), sizes.tolist())], np.uint64)


def merged(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Ranges sorted and joined where they touch or overlap, within each (doc, key)."""
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order].astype(np.int64), end[order].astype(np.int64)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    # Lift the ranges of each text above those before, so that one running maximum serves all.
    lift = np.cumsum(new) * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= (start + lift)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], key[at], start[at], np.maximum.reduceat(end, at) if len(at) else end


def repeated_ranges(
    docs: DataFrame, packed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT
) -> DataFrame:
    """(id, ranges) for ids whose texts lose bytes.

    ``docs`` has columns ``__id`` and ``__text``, ``packed`` ``__id`` and ``__packed``, the compressed texts. ranges
    packs (text key, start, end) of each text of the id.
    """
    count = bucket_count(docs, "__text", PER_BUCKET)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels = Parcels()
        for batch in batches:
            ids, valid = ids_of(batch.column(0))
            for texts in texts_of(batch.column(1), SLICE):
                text, _, _, picked = window_runs(texts, length, gram)
                keep = valid[texts.first + text]
                text, picked = text[keep], picked[keep]
                yield from parcels.add(picked % np.uint64(count), short(picked), ids[texts.first + text])
        yield from parcels.flush()

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels = Parcels()
        for bucket, rows in buckets(batches):
            picked, ids = open_parcels(rows)
            order = np.argsort(picked)
            picked, ids = picked[order], ids[order]
            at = np.flatnonzero(np.r_[True, picked[1:] != picked[:-1]])
            several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
            n = np.diff(np.r_[at, len(ids)])
            keep = np.repeat(several, n)
            # The bucket of a hot hash, plus one: with ``picked`` it tells the hash as it is told apart here.
            home = np.repeat(np.where(n > hot, bucket + 1, 0), n)[keep].astype(np.uint32)
            picked, ids = picked[keep], ids[keep]
            order = np.argsort(ids, kind="stable")
            yield from parcels.add(id_bucket(ids[order], count), picked[order], home[order], ids[order])
        yield from parcels.flush()

    def of_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            picked, home, ids = open_parcels(rows)
            order = np.argsort(ids, kind="stable")
            picked, home, ids = picked[order], home[order], ids[order]
            at = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            ends = np.r_[at[1:], len(ids)]
            blobs = [picked[a:b].tobytes() for a, b in zip(at, ends)]
            many = [homed(picked[a:b], home[a:b])[home[a:b] > 0].tobytes() for a, b in zip(at, ends)]
            for k in range(0, len(at), 4096):
                yield pa.record_batch({
                    "__key": pa.array(ids[at[k:k + 4096]]), "__held": pa.array(blobs[k:k + 4096], pa.binary()),
                    "__hot": pa.array(many[k:k + 4096], pa.binary())})

    held = by_bucket(docs.select("__id", "__text").mapInArrow(pick, PACKED), count).mapInArrow(shared, PACKED)
    held = by_bucket(held, count).mapInArrow(of_documents, "__key long, __held binary, __hot binary")
    candidates = packed.join(held.hint("shuffle_hash"), packed["__id"] == held["__key"], "left")

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = SpanPacker(count, length)
        for batch in batches:
            batch = batch.filter(batch.column("__held").is_valid())
            ids, _ = ids_of(batch.column("__id"))
            blobs, many = batch.column("__held").to_pylist(), batch.column("__hot").to_pylist()
            for texts in texts_of(inflated(batch.column("__packed")), SLICE):
                text, start, n, picked = window_runs(texts, length, gram)
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                keep, often = np.zeros(len(text), bool), np.zeros(len(text), bool)
                for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                    if a < b:
                        keep[a:b] = np.isin(short(picked[a:b]), np.frombuffer(blobs[texts.first + i], np.uint32))
                        if many[texts.first + i]:
                            own = homed(short(picked[a:b]), picked[a:b] % np.uint64(count) + np.uint64(1))
                            often[a:b] = np.isin(own, np.frombuffer(many[texts.first + i], np.uint64))
                text, start, n, picked, often = text[keep], start[keep], n[keep], picked[keep], often[keep]
                if len(text):
                    own = np.array([text_key(texts.text(i)) for i in range(len(texts))], np.uint64)
                    yield from packer.add(
                        texts.data, start, n + (length - 1), picked, ids[texts.first + text], own[text],
                        start - texts.offsets[text], often)
        yield from packer.flush()

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parcels = Parcels()
        for _, rows in buckets(batches):
            doc, key, start, end = covered_ranges(*unpack_spans(rows), length)
            order = np.lexsort((start, key, doc))
            yield from parcels.add(id_bucket(doc[order], count), doc[order], key[order], start[order], end[order])
        yield from parcels.flush()

    def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            doc, key, start, end = merged(*open_parcels(rows))
            at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, np.int64)
            blobs = [
                b"".join(x.tobytes() for x in (key[a:b], start[a:b], end[a:b]))
                for a, b in zip(at, np.r_[at[1:], len(doc)])]
            for k in range(0, len(at), 4096):
                yield pa.record_batch({
                    "__key": pa.array(doc[at[k:k + 4096]]), "__ranges": pa.array(blobs[k:k + 4096], pa.binary())})

    found = candidates.select("__id", "__packed", "__held", "__hot").mapInArrow(spans, PACKED)
    found = by_bucket(found, count).mapInArrow(cover, PACKED)
    return by_bucket(found, count).mapInArrow(by_id, "__key long, __ranges binary")


def short(picked: np.ndarray) -> np.ndarray:
    """The part of a hash that tells the entries of one bucket apart."""
    return (picked >> np.uint64(32)).astype(np.uint32)


def homed(picked: np.ndarray, home: np.ndarray) -> np.ndarray:
    """A short hash and its bucket plus one in one number."""
    return home.astype(np.uint64) << np.uint64(32) | picked.astype(np.uint64)


def id_bucket(ids: np.ndarray, count: int) -> np.ndarray:
    return (ids.astype(np.uint64) * np.uint64(STEP) >> np.uint64(33)) % np.uint64(count)


class SpanPacker:
    """Like :class:`Packer` for spans of bytes; spans that repeat whole within it are settled by the smallest id.

    Spans of hot hashes that are not settled so are cut into their windows, dealt by window; what is settled goes by id.
    """

    def __init__(self, count: int, length: int = LENGTH, limit: int = 16 << 20):
        self.count, self.length, self.limit, self.held, self.size = count, length, limit, [], 0

    def add(self, data, starts, sizes, picked, ids, keys, places, hot) -> Iterator[pa.RecordBatch]:
        content = gather(data, starts, sizes)
        self.held.append((content, sizes, picked, ids, keys, places, hot))
        self.size += len(content)
        if self.size >= self.limit:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        content, sizes, picked, ids, keys, places, hot = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        first = np.cumsum(sizes) - sizes
        settled = repeats(content_hashes(content, first, sizes), sizes, ids)
        bucket = (picked % np.uint64(self.count)).astype(np.int32)
        done = hot & (settled > 0)
        bucket[done] = id_bucket(ids[done], self.count).astype(np.int32)
        whole = np.flatnonzero(~hot | done)
        if len(whole):
            yield self.rows(
                content, first[whole], sizes[whole], bucket[whole], ids[whole], keys[whole], places[whole], settled[whole])
        # Spans of one hash one after another, so that their equal windows are cut together.
        cut = np.flatnonzero(hot & ~done)
        cut = cut[np.argsort(picked[cut], kind="stable")]
        n = sizes[cut] - (self.length - 1)
        ends = np.cumsum(n)
        begin = 0
        while begin < len(cut):
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] - n[begin] + CUT, side="right")))
            span = np.repeat(cut[begin:stop], n[begin:stop])
            step = np.arange(len(span)) - np.repeat(ends[begin:stop] - n[begin:stop] - (ends[begin] - n[begin]), n[begin:stop])
            starts, size = first[span] + step, np.full(len(span), self.length, sizes.dtype)
            hashes = content_hashes(content, starts, size)
            settled = repeats(hashes, size, ids[span])
            bucket = np.where(settled > 0, id_bucket(ids[span], self.count), hashes % np.uint64(self.count))
            yield self.rows(
                content, starts, size, bucket.astype(np.int32), ids[span], keys[span], places[span] + step, settled)
            begin = stop

    def rows(self, content, first, sizes, bucket, ids, keys, places, settled) -> pa.RecordBatch:
        order = np.lexsort((places, keys, ids, bucket))
        edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
        rows = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            part = order[lo:hi]
            open_ = part[settled[part] == 0]
            rows.append(squeeze(
                ids[part], keys[part], places[part].astype(np.uint32), sizes[part].astype(np.uint32), settled[part],
                gather(content, first[open_], sizes[open_])))
        return parcel_rows(bucket[order[edges[:-1]]], rows)


def repeats(hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """1 for each span that a smaller id holds as well."""
    order = np.lexsort((ids, sizes, hashes))
    h, s, d = hashes[order], sizes[order], ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    settled = np.zeros(len(order), np.uint8)
    settled[order] = d > d[new][np.cumsum(new) - 1]
    return settled


def unpack_spans(rows: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    *fixed, content = open_parcels(rows)
    return fixed, content


RESULT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("removed", T.BinaryType()),
    T.StructField("kept", T.BinaryType())])


def remove_repeats(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", carry: Sequence[str] = (),
    length: int = LENGTH, gram: int = GRAM, whole_characters: bool = False, hot: int = HOT,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the carried columns, n_bytes, n_removed, n_spans, removed, kept.

    kept holds the remaining bytes; removed the removed runs as pairs of little-endian unsigned 32-bit numbers, start
    and end, all starts first. ``gram`` must be well below ``length``; it and ``hot`` change the work, not the result.
    """
    own = docs.select(
        F.col(id_column).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"),
        *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)])
    kept = [f for f in own.schema if f.name != "__text"]
    passed = [f.name for f in kept]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in passed] + [deflated(batch.column("__text"))], names=[*passed, "__packed"])

    packed = own.mapInArrow(pack, T.StructType([*kept, T.StructField("__packed", T.BinaryType())]))
    ranges = repeated_ranges(own, packed, length, gram, hot)
    joined = packed.join(ranges.hint("shuffle_hash"), packed["__id"] == ranges["__key"], "left").drop("__key")
    schema = T.StructType(kept + RESULT.fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column("__ranges").to_pylist()
            for texts in texts_of(inflated(batch.column("__packed")), 8 << 20):
                rows = []
                for i in range(len(texts)):
                    *found, kept_bytes = cut_text(texts.text(i), blobs[texts.first + i])
                    if whole_characters:
                        kept_bytes = kept_bytes.decode("utf-8", "ignore").encode()
                    rows.append((*found, kept_bytes))
                parts = [batch.column(c).slice(texts.first, len(texts)) for c in passed]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                made = [pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(parts + made, names=passed + RESULT.names)

    out = joined.mapInArrow(cut, schema)
    return out.select(
        F.col("__id").alias("doc_id"), *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)], *RESULT.names)


def cut_text(text: bytes, blob: bytes | None) -> tuple[int, int, int, bytes, bytes]:
    if not blob:
        return len(text), 0, 0, b"", text
    n = len(blob) // 24
    mine = np.frombuffer(blob, np.uint64, n) == np.uint64(text_key(text))
    start, end = np.frombuffer(blob, np.int64, n, 8 * n)[mine], np.frombuffer(blob, np.int64, n, 16 * n)[mine]
    kept, at = [], 0
    for a, b in zip(start.tolist(), end.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    removed = start.astype(np.uint32).tobytes() + end.astype(np.uint32).tobytes()
    return len(text), int((end - start).sum()), len(start), removed, b"".join(kept)
