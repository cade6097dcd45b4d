"""SimHash near-duplicates by a binary trie joined with itself.

``fingerprints`` gives each text 64 bits; ``similar`` links fingerprints that differ in few bits and names each
document's component. Two tries are never compared whole. The 64 bits are cut into blocks; fingerprints within
``budget`` bits of each other agree on all but ``budget`` of the blocks, so the trie is built once per choice of
agreeing blocks and dealt over tasks by their bits. Below that, node pairs are followed together from the first
bit, differing bits are added up, and a pair is left as soon as they exceed the budget.

``near_copies`` is for texts that are alike rather than the same: the parts of a fingerprint of many bits, joined in the
same way, find the pairs to compare, and the shingle sets of each such pair decide.

Nulls and texts without a word have fingerprint 0 and are linked to each other as any others. Repeated texts
and fingerprints are reduced to one before they are joined, so a group of copies costs one entry. A bucket larger
than ``SHARE`` is cut into shares and each pair of shares is one group. Columns of other names are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.spark import discard, may_be_among, presence
from plumbline.llm.texts import STEP, mixed, texts_of
from plumbline.session import cut_lineage

SEED = 42
BITS = 64
# Fingerprints of a bucket that one task joins at once, and how many a bucket may hold on average.
SHARE = 8192
AVERAGE = 2048
# Each byte spread over eight bytes, so that bits are counted eight at a time.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(text: bytes, size: int = 3) -> int:
    """The majority of each bit over the hashes of all word shingles; 0 without a word."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    spread = _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(spread), 255):
        counts += spread[at:at + 255].sum(axis=0).view(np.uint8)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The sorted hashes of the word shingles; a shingle counts once however often it occurs."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*[words[i:] for i in range(size)]))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(s, SEED) for s in shingles], np.uint64))


def set_name(hashes: np.ndarray) -> int:
    """Equal sets have equal names, as signed longs."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def wide_fingerprint(hashes: np.ndarray, parts: int) -> bytes:
    """``parts`` independent fingerprints of a set of shingles, end to end."""
    if not len(hashes):
        return bytes(8 * parts)
    out = []
    for k in range(parts):
        spread = _SPREAD[mixed(hashes + np.uint64((k + 1) * STEP % 2**64)).view(np.uint8).reshape(-1, 8)]
        counts = np.zeros(BITS, np.int64)
        for at in range(0, len(spread), 255):
            counts += spread[at:at + 255].sum(axis=0).view(np.uint8)
        out.append(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes())
    return b"".join(out)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.text(i), size) for t in texts_of(batch.column(1)) for i in range(len(t))]
            yield pa.record_batch({
                "doc_id": batch.column(0), "fp": pa.array(np.array(found, np.uint64).view(np.int64))})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def blocks_for(count: int, budget: int) -> int:
    """Fewest blocks whose agreeing bits leave small buckets for ``count`` spread fingerprints."""
    for n in range(budget + 1, budget + 5):
        agreeing = (n - budget) * (BITS // n)
        if count / 2**min(agreeing, 62) <= AVERAGE:
            return n
    return budget + 4


def trie_pairs(values: np.ndarray, groups: np.ndarray, budget: int, bits: int = BITS, at_once: int = 400_000):
    """Pairs (i, j) of positions within ``budget`` of ``bits`` bits of each other.

    ``values`` are sorted within each group. ``groups`` has rows (a_lo, a_hi, b_lo, b_hi): the two tries to be
    joined, as ranges of ``values``; equal ranges are a trie joined with itself. All groups are
    followed level by level; a wide frontier is followed in parts.
    """
    work = [(0, groups, np.zeros(len(groups), np.int8))]
    while work:
        level, front, differ = work.pop()
        if not len(front):
            continue
        a, b = front[:, 1] - front[:, 0], front[:, 3] - front[:, 2]
        small = (a * b <= 16) | (level == bits)
        if small.any():
            few = front[small]
            sizes = (few[:, 1] - few[:, 0]) * (few[:, 3] - few[:, 2])
            if len(few) > 1 and sizes.sum() > 4 * at_once:
                half = len(front) // 2
                work += [(level, front[half:], differ[half:]), (level, front[:half], differ[:half])]
                continue
            which = np.repeat(np.arange(len(few)), sizes)
            step = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            width = (few[:, 3] - few[:, 2])[which]
            i, j = few[which, 0] + step // width, few[which, 2] + step % width
            near = np.bitwise_count(values[i] ^ values[j]) <= budget
            near &= (i < j) | (few[which, 0] != few[which, 2])
            yield i[near], j[near]
            front, differ = front[~small], differ[~small]
        if not len(front):
            continue
        if len(front) > at_once:
            half = len(front) // 2
            work += [(level, front[:half], differ[:half]), (level, front[half:], differ[half:])]
            continue
        ones = np.r_[0, np.cumsum((values >> np.uint64(bits - 1 - level)) & np.uint64(1), dtype=np.int64)]
        mid_a = front[:, 1] - (ones[front[:, 1]] - ones[front[:, 0]])
        mid_b = front[:, 3] - (ones[front[:, 3]] - ones[front[:, 2]])
        same = front[:, 0] == front[:, 2]
        more = differ < budget
        parts, costs = [], []
        for lo_a, hi_a, lo_b, hi_b, cost, keep in (
            (front[:, 0], mid_a, front[:, 2], mid_b, 0, None),
            (mid_a, front[:, 1], mid_b, front[:, 3], 0, None),
            (front[:, 0], mid_a, mid_b, front[:, 3], 1, more),
            (mid_a, front[:, 1], front[:, 2], mid_b, 1, more & ~same),
        ):
            alive = (lo_a < hi_a) & (lo_b < hi_b)
            if keep is not None:
                alive &= keep
            alive &= ~(same & (cost == 0) & (hi_a - lo_a < 2))
            parts.append(np.stack([lo_a, hi_a, lo_b, hi_b], axis=1)[alive])
            costs.append((differ + np.int8(cost))[alive])
        work.append((level + 1, np.concatenate(parts), np.concatenate(costs)))


class Forest:
    """Sets of positions, each known by its smallest member; hands on one link per joined entry, not every pair."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.root[i] != self.root[j]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]
            left = self.apart(i, j)
            i, j = i[left], j[left]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        inner = np.flatnonzero(self.root != np.arange(len(self.root)))
        return self.root[inner], inner


def grouped(table: pa.Table, limit: int | None):
    """(order of the rows, sorted values, sorted whole fingerprints or None, groups for ``trie_pairs``)."""
    key, i, j, side = (table.column(c).to_numpy() for c in ("key", "i", "j", "side"))
    values = table.column("value").to_numpy().view(np.uint64)
    order = np.lexsort((values, side, j, i, key))
    key, i, j, side, values = key[order], i[order], j[order], side[order], values[order]
    whole = None
    if limit is not None:
        joined = b"".join(table.column("whole").to_pylist())
        whole = np.frombuffer(joined, np.uint64).reshape(len(order), -1)[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    lo = np.flatnonzero(new)
    hi = np.r_[lo[1:], len(key)]
    firsts = np.r_[0, np.cumsum(side == 0)]
    mid = lo + firsts[hi] - firsts[lo]
    own = i[lo] == j[lo]
    groups = np.stack([lo, np.where(own, hi, mid), np.where(own, lo, mid), hi], axis=1)
    groups = groups[np.where(own, hi - lo > 1, (mid > lo) & (hi > mid))]
    return order, values, whole, groups


def join_groups(table: pa.Table, budget: int, bits: int, limit: int | None) -> pa.RecordBatch:
    """Links among the nodes of whole groups (columns key, i, j, side, node, value, whole).

    Pairs of values within ``budget`` bits are linked; with ``limit`` only if the whole fingerprints differ in at most
    that many bits.
    """
    order, values, whole, groups = grouped(table, limit)
    nodes = table.column("node").to_numpy()[order]
    forest = Forest(len(values))
    for a, b in trie_pairs(values, groups, budget, bits):
        for at in range(0, len(a), 1 << 18):
            x, y = a[at:at + (1 << 18)], b[at:at + (1 << 18)]
            open_ = forest.apart(x, y)
            x, y = x[open_], y[open_]
            if whole is not None:
                near = np.bitwise_count(whole[x] ^ whole[y]).sum(axis=1) <= limit
                x, y = x[near], y[near]
            forest.join(x, y)
    a, b = forest.links()
    return pa.record_batch({"a": pa.array(nodes[a]), "b": pa.array(nodes[b])})


def fingerprint_links(distinct: DataFrame, budget: int = 3, share: int = SHARE) -> DataFrame:
    """Links (a, b) that connect whatever distinct fingerprints ``fp`` are connected by pairs within ``budget``."""
    n = blocks_for(distinct.count(), budget)
    edges = [round(k * BITS / n) for k in range(n + 1)]
    blocks = [
        F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)) for k in range(n)]
    keys = [F.xxhash64(F.lit(t), *[blocks[k] for k in chosen])
            for t, chosen in enumerate(combinations(range(n), n - budget))]
    rows = distinct.select(F.col("fp").alias("node"), F.col("fp").alias("value"), F.explode(F.array(*keys)).alias("key"))
    return bucket_links(
        rows.withColumn("whole", F.lit(None).cast("binary")), lambda table: join_groups(table, budget, BITS, None), share)


def bucket_links(rows: DataFrame, joined: Callable[[pa.Table], pa.RecordBatch], share: int = SHARE) -> DataFrame:
    """Links (a, b) from rows (key, node, value, whole): those that ``joined`` finds among the rows of whole groups.

    Rows of one key are a group; a key with more than ``share`` of them is cut into shares, and each pair of shares is a group.
    """
    carried = ["node", "value", "whole"]
    rows = rows.select("key", *carried)
    large = rows.groupBy("key").count().where(F.col("count") > share)
    large = cut_lineage(large.select("key", F.ceil(F.col("count") / share).cast("int").alias("shares")), "shares")
    if large.isEmpty():
        rows = rows.select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), *carried)
    else:
        # Share s of a large bucket meets share t in group (s, t), and itself in (s, s).
        rows = rows.join(large, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
        rows = rows.withColumn("s", own).select(
            "key", *carried, "s", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("t"))
        rows = rows.select("key", F.least("s", "t").alias("i"), F.greatest("s", "t").alias("j"),
                           (F.col("s") > F.col("t")).cast("int").alias("side"), *carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < 8 * share:
                continue
            table = pa.concat_tables(held).combine_chunks()
            last = [table.column(c)[size - 1].as_py() for c in ("key", "i", "j")]
            same = np.ones(size, bool)
            for c, v in zip(("key", "i", "j"), last):
                same &= table.column(c).to_numpy() == v
            # Rows arrive sorted by group; the last group may go on in the next batch.
            cut = int(np.argmin(same[::-1])) if not same.all() else size
            if cut < size:
                yield joined(table.slice(0, size - cut).combine_chunks())
                held, size = [table.slice(size - cut)], cut
        if size:
            yield joined(pa.concat_tables(held).combine_chunks())

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long")


# Fingerprints whose halves near_copies joins, the first of them that travel whole, and the bits in which two halves may
# differ to be compared.
PARTS, WHOLE_PARTS, HALF_BITS, HALF_BUDGET = 12, 2, 32, 3
# Sets of a group that one task compares at once.
SET_SHARE = 4096


def bits_for(similarity: float, bits: int, errors: float = 1.0) -> int:
    """Differing bits expected of sets so similar, and some standard errors more."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * p + errors * math.sqrt(bits * p * (1 - p)))


def shared_with(x: int, sets: list[np.ndarray], tokens: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """How many shingles each set has in common with set ``x``; ``tokens`` are those of all sets, sorted, with their owners."""
    lo, hi = (np.searchsorted(tokens, sets[x], side) for side in ("left", "right"))
    n = hi - lo
    places = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    return np.bincount(owners[places], minlength=len(sets))


def join_sets(table: pa.Table, similarity: float) -> pa.RecordBatch:
    """Links that connect, among the rows of whole groups, the nodes whose sets are so similar.

    ``whole`` holds the sorted shingles. A node is compared with those it is not connected with yet, all at once.
    """
    key, i, j, side, node = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "node"))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    edges = np.r_[np.flatnonzero(new), len(key)]
    out: list[tuple[int, int]] = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi - lo < 2:
            continue
        sets = [np.frombuffer(w.as_buffer(), np.uint32) for w in table.column("whole").slice(lo, hi - lo)]
        sizes = np.array([len(g) for g in sets])
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        tokens, owners = every[order], np.repeat(np.arange(len(sets)), sizes)[order]
        comp, sides = np.arange(len(sets)), side[lo:hi]
        cross = i[lo] != j[lo]
        for x in range(len(sets)):
            apart = comp != comp[x]
            if cross:
                # Pairs of equal sides are compared elsewhere; one side's nodes see all of the other.
                if sides[x]:
                    continue
                apart &= sides == 1
            if not apart.any():
                continue
            shared = shared_with(x, sets, tokens, owners)
            for y in np.flatnonzero(apart & (shared >= similarity * (sizes + sizes[x] - shared)) & (shared > 0)).tolist():
                if comp[x] != comp[y]:
                    out.append((node[lo + x], node[lo + y]))
                    comp[comp == comp[y]] = comp[x]
    a, b = zip(*out) if out else ((), ())
    return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def shingle_sets(texts: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(node, whole) for the rows of a table of one column, the text: its shingles as sorted 32-bit numbers.

    Rows whose node is not among the ``wanted`` are left out but for a few.
    Two texts of a thousand words each have a chance of one in some 4,000 that two different shingles look alike.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts_of(batch.column(0)):
                found = [shingle_set(t.text(i), size) for i in range(len(t))]
                names = np.array([set_name(h) for h in found], np.int64)
                kept = np.flatnonzero(may_be_among(wanted, names))
                yield pa.record_batch({
                    "node": pa.array(names[kept]),
                    "whole": pa.array([np.unique(found[i].astype(np.uint32)).tobytes() for i in kept], pa.binary())})

    return texts.mapInArrow(run, "node long, whole binary")


def near_copies(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(doc_id, component_id): documents whose sets of word shingles are similar are in one component.

    The similarity is shared shingles over all shingles of two texts, at least ``similarity`` for a link. Texts are likely
    copies if one of the 2 * PARTS halves agrees but for HALF_BUDGET bits and 64 * WHOLE_PARTS bits differ by no more than four
    standard errors above what is expected; at a similarity of 0.8 both let some 999 in 1000 through, and more above. The
    tries connect likely copies with one link for each entry, not with every pair.

    Only sets decide. The sets of a group of likely copies meet in one task, a large group's in shares of SET_SHARE that meet
    pair by pair, and are compared unless they are connected; a task hands on links that connect, no pairs. Sets are
    made once more from the texts rather than kept beside the fingerprints. Texts of fewer words are one shingle; those
    without any are alike. A null id takes part and is given back as null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for t in texts_of(batch.column(1)):
                for i in range(len(t)):
                    hashes = shingle_set(t.text(i), size)
                    names.append(set_name(hashes))
                    found.append(wide_fingerprint(hashes, PARTS))
            yield pa.record_batch({
                "doc_id": batch.column(0), "node": pa.array(names, pa.int64()), "parts": pa.array(found, pa.binary())})

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    marked = cut_lineage(rows.mapInArrow(run, "doc_id long, node long, parts binary"), "fingerprints")
    distinct = cut_lineage(
        marked.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("parts").alias("parts")), "distinct")
    n = HALF_BUDGET + 1
    width = HALF_BITS // n

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                parts = part.column(1).to_pylist()
                whole = pa.array([p[:8 * WHOLE_PARTS] for p in parts], pa.binary())
                each = np.frombuffer(b"".join(parts), "<u4").reshape(part.num_rows, -1)
                for h in range(each.shape[1]):
                    value = each[:, h].astype(np.uint64)
                    for b in range(n):
                        block = value >> np.uint64(b * width) & np.uint64((1 << width) - 1)
                        key = mixed(block + np.uint64((h * n + b + 1) << HALF_BITS))
                        yield pa.record_batch({
                            "key": pa.array(key.view(np.int64)), "node": part.column(0),
                            "value": pa.array(value.view(np.int64)), "whole": whole})

    entries = distinct.select("node", "parts").mapInArrow(halves, "key long, node long, value long, whole binary")
    limit = bits_for(similarity, 64 * WHOLE_PARTS, 4.0)
    likely = cut_lineage(
        components(bucket_links(entries, lambda t: join_groups(t, HALF_BUDGET, HALF_BITS, limit))), "likely")
    wanted = presence(likely, F.col("node"))
    sets = shingle_sets(rows.select("text"), size, wanted).join(likely, "node").dropDuplicates(["node"])
    members = cut_lineage(sets.select(F.col("root").alias("key"), "node", F.lit(0).cast("long").alias("value"), "whole"), "sets")
    links = cut_lineage(bucket_links(members, lambda t: join_sets(t, similarity), SET_SHARE), "links")
    discard(members)
    roots = components(links)
    placed = cut_lineage(
        distinct.select("node", "first").join(roots, "node", "left")
        .withColumn("root", F.coalesce("root", "node")), "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(placed.join(named, "root").select("node", "component_id"), "classes")
    return marked.join(classes, "node").select("doc_id", "component_id")


def similar(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", budget: int = 3, size: int = 3
) -> DataFrame:
    """(doc_id, fp, component_id, copies): one row for each row of ``docs``.

    component_id is the smallest id that can be reached over links of at most ``budget`` differing bits; copies
    is the number of rows with the same fingerprint. A null id takes part, but names no component unless all its
    members lack one.
    """
    marked = cut_lineage(fingerprints(docs, id_column, text, size), "fingerprints")
    distinct = cut_lineage(
        marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")), "distinct")
    roots = components(fingerprint_links(distinct, budget)).select(F.col("node").alias("fp"), "root")
    placed = cut_lineage(
        distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut_lineage(placed.join(named, "root").select("fp", "component_id", "copies"), "classes")
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "copies")
