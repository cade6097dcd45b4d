"""A probabilistic suffix tree over words: learned from the corpus, used to score every document.

States are contexts, the last words before a token. A context is a candidate if it makes up at least ``P_MIN`` of all
training positions, so there are at most 1 / ``P_MIN`` candidates of each length whatever the corpus; only
these travel to every task. Next-word counts are not bounded and stay in buckets by word. A candidate is retained if
its next-word distribution diverges from that of its suffix: the mean gain in log probability, each
occurrence predicted from the others, must reach ``LEAST_GAIN`` for some strength of smoothing. The suffixes
of retained states are retained. A token is scored in the longest retained suffix of what precedes it; a
state's distribution is smoothed towards its suffix's, and the empty context is the add-one-half word model.

Tokens are the words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and one end per text, known by 64-bit hashes.
Nulls are empty texts: one end. Documents without an id belong to the part that ``training`` gives them, a null
being no. Rows that repeat an id or a text count as often as they occur. An empty table gives an empty
result; without training texts all probability is the add-one-half model's of no tokens. Other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spark import bucket_count, by_bucket
from plumbline.llm.texts import (
    Packer, Texts, buckets, deflated, expand, inflated, mixed, squeeze, texts_of, unpack, word_bounds, word_hashes,
)
from plumbline.session import cut_lineage

P_MIN = 2e-5
DEPTH = 2
LEAST_GAIN = 0.002
SMOOTHING = (4.0, 32.0, 256.0, 2048.0)
# Smoothing of a suffix while the states below it are tested.
SUFFIX_SMOOTHING = 256.0
PER_BUCKET = 12 << 20
# Tokens a task holds before it hands them on.
HELD = 2_000_000
START, END = np.uint64(2), np.uint64(1)
BLOBS = "bucket int, entries binary"


@dataclass
class Tree:
    """Candidate or retained states; state 0 is the empty context.

    ``symbols`` are the sorted hashes of words that occur in contexts, ``known`` their counts as tokens; the
    state of the context of one symbol has that symbol's number plus one. ``keys[d]`` are, sorted, suffix state
    times (symbols + 1) plus the symbol before it, and ``states[d]`` the states of length d + 2 they lead to.
    """

    symbols: np.ndarray
    known: np.ndarray
    keys: list[np.ndarray]
    states: list[np.ndarray]
    count: np.ndarray
    parent: np.ndarray
    depth: np.ndarray
    smoothing: np.ndarray
    tokens: int
    types: int
    longest: np.ndarray | None = None

    @property
    def width(self) -> int:
        return len(self.symbols) + 1

    def symbol(self, h: np.ndarray) -> np.ndarray:
        """One plus the number of each hash's symbol, 0 for others."""
        at = np.searchsorted(self.symbols, h)
        at[at == len(self.symbols)] = 0
        return np.where(self.symbols[at] == h, at + 1, 0)

    def ancestors(self) -> list[np.ndarray]:
        """For each length d from 1 on, the suffix of length d of each state, 0 for shorter ones."""
        out, current = [], np.arange(len(self.count))
        for d in range(int(self.depth.max(initial=0)), 0, -1):
            current = np.where(self.depth[current] > d, self.parent[current], current)
            out.append(np.where(self.depth[current] == d, current, 0))
        return out[::-1]

    def contexts(self, sequence: np.ndarray, at: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The longest state before each position ``at`` of a sequence of hashes; ``begin``: its text's start."""
        symbol = self.symbol(sequence)
        state = symbol[at - 1]
        deepest = state.copy()
        for k, (keys, states) in enumerate(zip(self.keys, self.states)):
            if not len(keys):
                break
            back = at - (k + 2)
            wanted = state * self.width + symbol[np.maximum(back, 0)]
            found = np.searchsorted(keys, wanted)
            found[found == len(keys)] = 0
            ok = (keys[found] == wanted) & (back >= begin) & (state > 0) & (symbol[np.maximum(back, 0)] > 0)
            state = np.where(ok, states[found], 0)
            deepest = np.where(ok, state, deepest)
        return deepest

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.5) / (self.tokens + 0.5 * (self.types + 1))


def sequences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with a start and an end around each text's words, token positions, their text's start, their text)."""
    starts, ends = word_bounds(texts)
    owner = texts.owner(starts)
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n + 2) - (n + 2)
    out = np.empty(len(starts) + 2 * len(texts), np.uint64)
    out[first] = START
    out[first + n + 1] = END
    out[np.arange(len(starts)) + 2 * owner + 1] = word_hashes(texts, starts, ends)
    token = np.ones(len(out), bool)
    token[first] = False
    at = np.flatnonzero(token)
    text = np.repeat(np.arange(len(texts)), n + 1)
    return out, at, first[text], text


def rows_of(names: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.record_batch({"bucket": pa.array(names, pa.int32()), "entries": pa.array(blobs, pa.binary())})


def word_runs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal words begin, and their lengths."""
    at = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(words)])


def token_counts(texts: DataFrame, count: int) -> DataFrame:
    """Per bucket of words: tokens, types, and the words that may be frequent."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer([np.uint64, np.int64])
        held, size = [], 0
        for batch in batches:
            for t in texts_of(batch.column(0)):
                sequence, at, _, _ = sequences(t)
                held.append(sequence[at])
                size += len(at)
                if size >= HELD:
                    words, n = np.unique(np.concatenate(held), return_counts=True)
                    yield from packer.add(words % np.uint64(count), words, n)
                    held, size = [], 0
        if held:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            yield from packer.add(words % np.uint64(count), words, n)
        yield from packer.flush()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            words, n = unpack(rows, [np.uint64, np.int64])
            order = np.argsort(words)
            at, _ = word_runs(words[order])
            words, n = words[order][at], np.add.reduceat(n[order], at)
            often = n >= P_MIN * n.sum()
            yield pa.record_batch({
                "tokens": pa.array([int(n.sum())]), "types": pa.array([len(n)]),
                "words": pa.array([words[often].view(np.int64).tolist()], pa.list_(pa.int64())),
                "counts": pa.array([n[often].tolist()], pa.list_(pa.int64()))})

    found = by_bucket(texts.mapInArrow(tally, BLOBS), count)
    return found.mapInArrow(total, "tokens long, types long, words array<long>, counts array<long>")


def first_tree(texts: DataFrame, count: int) -> Tree:
    """The empty context and the candidates of one symbol."""
    found = cut_lineage(token_counts(texts, count), "words")
    sums = found.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(sums[0] or 0), int(sums[1] or 0)
    each = found.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select("w.words", "w.counts")
    # At most 1 / P_MIN words, and the end.
    end = F.col("words") == F.lit(int(END))
    often = each.where((F.col("counts") >= F.lit(P_MIN * tokens)) | end).toPandas()
    words, n = often["words"].to_numpy(np.int64).view(np.uint64), often["counts"].to_numpy(np.int64)
    ends = int(n[words == END].sum())
    words, n = np.r_[words[words != END], START, END], np.r_[n[words != END], 0, ends]
    order = np.argsort(words)
    symbols, known = words[order], n[order]
    # As a context the start occurs once per text; the end never precedes a token.
    context = np.where(symbols == START, ends, np.where(symbols == END, 0, known))
    size = len(symbols) + 1
    return Tree(symbols, known, [], [], np.r_[tokens, context], np.zeros(size, np.int64),
                np.r_[0, np.ones(size - 1, np.int64)], np.full(size, SUFFIX_SMOOTHING), tokens, types)


def extended(texts: DataFrame, count: int, tree: Tree) -> Tree:
    """The tree with the candidates that are one symbol longer."""
    length = int(tree.depth.max()) + 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer([np.int64, np.int64])
        held, size = [], 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return packer.add(mixed(keys.astype(np.uint64)) % np.uint64(count), keys, n)

        for batch in batches:
            for t in texts_of(batch.column(0)):
                sequence, at, begin, _ = sequences(t)
                state = tree.contexts(sequence, at, begin)
                ok = (tree.depth[state] == length - 1) & (at - length >= begin)
                before = tree.symbol(sequence[at[ok] - length])
                held.append((state[ok] * tree.width + before)[before > 0])
                size += len(held[-1])
                if size >= HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()
        yield from packer.flush()

    least = max(2.0, P_MIN * tree.tokens)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            keys, n = unpack(rows, [np.int64, np.int64])
            order = np.argsort(keys)
            at, _ = word_runs(keys[order])
            keys, n = keys[order][at], np.add.reduceat(n[order], at)
            keep = n >= least
            yield pa.record_batch({"key": pa.array(keys[keep]), "n": pa.array(n[keep])})

    found = by_bucket(texts.mapInArrow(tally, BLOBS), count).mapInArrow(total, "key long, n long").toPandas()
    keys, n = found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = len(tree.count) + np.arange(len(keys))
    return Tree(tree.symbols, tree.known, [*tree.keys, keys], [*tree.states, new], np.r_[tree.count, n],
                np.r_[tree.parent, keys // tree.width], np.r_[tree.depth, np.full(len(keys), length)],
                np.r_[tree.smoothing, np.full(len(keys), SUFFIX_SMOOTHING)], tree.tokens, tree.types)


def word_bucket(tree: Tree, words: np.ndarray, state: np.ndarray, first: np.ndarray, count: int) -> np.ndarray:
    """By word; a word known to be frequent is spread by the last word of its context as well."""
    often = tree.symbol(words) > 0
    spread = mixed(words + first[state].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (np.where(often, spread, words) % np.uint64(count)).astype(np.int32)


def keyed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, their summed weights, which of them each row has)."""
    distinct, which = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(which, weights=weights, minlength=len(distinct)), which


def word_counts(tree: Tree, words: np.ndarray, which: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Training count of each distinct word: known for frequent ones, else all its rows are here."""
    symbol = tree.symbol(words)
    here = np.bincount(which, weights=n, minlength=len(words))
    return np.where(symbol > 0, np.r_[0, tree.known][symbol], here)


def gains(texts: DataFrame, count: int, tree: Tree) -> np.ndarray:
    """Summed gain of each state over its suffix, one column per strength of smoothing."""
    ancestors = tree.ancestors()
    size = len(tree.count)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size_held = [], 0

        def flush():
            words, state = (np.concatenate(x) for x in zip(*held))
            bucket = word_bucket(tree, words, state, ancestors[0], count)
            order = np.lexsort((state, words, bucket))
            words, state, bucket = words[order], state[order], bucket[order]
            new = np.r_[True, (words[1:] != words[:-1]) | (state[1:] != state[:-1])]
            at = np.flatnonzero(new)
            n = np.diff(np.r_[at, len(words)]).astype(np.uint32)
            words, state, bucket = words[at], state[at].astype(np.uint32), bucket[at]
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
            names, blobs = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                run, sizes = word_runs(words[a:b])
                names.append(int(bucket[a]))
                blobs.append(squeeze(words[a:b][run], sizes.astype(np.uint32), state[a:b], n[a:b]))
            return rows_of(names, blobs)

        for batch in batches:
            for t in texts_of(batch.column(0)):
                sequence, at, begin, _ = sequences(t)
                held.append((sequence[at], tree.contexts(sequence, at, begin)))
                size_held += len(at)
                if size_held >= HELD:
                    yield flush()
                    held, size_held = [], 0
        if held:
            yield flush()

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer([np.int64] + [np.float64] * len(SMOOTHING))
        for _, rows in buckets(batches):
            parts = [expand(row) for row in rows]
            words = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            state = np.concatenate([p[2] for p in parts]).astype(np.int64)
            n = np.concatenate([p[3] for p in parts]).astype(np.float64)
            distinct, which = np.unique(words, return_inverse=True)
            suffix = tree.base(word_counts(tree, distinct, which, n))[which]
            sums = np.zeros((len(SMOOTHING), size))
            for above in ancestors:
                s = above[state]
                keep = s > 0
                if not keep.any():
                    break
                _, c, at = keyed(which[keep] * size + s[keep], n[keep])
                one = np.zeros(len(c), np.int64)
                one[at] = np.flatnonzero(keep)
                p, own = suffix[one], s[one]
                total = tree.count[own]
                for k, strength in enumerate(SMOOTHING):
                    gain = c * np.log((c - 1 + strength * p) / ((total - 1 + strength) * p))
                    sums[k] += np.bincount(own, weights=gain, minlength=size)
                smoothed = (c + SUFFIX_SMOOTHING * p) / (total + SUFFIX_SMOOTHING)
                suffix = suffix.copy()
                suffix[keep] = smoothed[at]
            hit = np.flatnonzero(sums.any(axis=0))
            yield from packer.add(hit % parts_out, hit, *sums[:, hit])
        yield from packer.flush()

    parts_out = min(count, 64)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in buckets(batches):
            state, *sums = unpack(rows, [np.int64] + [np.float64] * len(SMOOTHING))
            distinct, which = np.unique(state, return_inverse=True)
            yield pa.record_batch({"state": pa.array(distinct), **{
                f"g{k}": pa.array(np.bincount(which, weights=s)) for k, s in enumerate(sums)}})

    found = by_bucket(texts.mapInArrow(tally, BLOBS), count).mapInArrow(test, BLOBS)
    columns = "state long, " + ", ".join(f"g{k} double" for k in range(len(SMOOTHING)))
    rows = by_bucket(found, parts_out).mapInArrow(total, columns).toPandas()
    out = np.zeros((size, len(SMOOTHING)))
    out[rows["state"].to_numpy(np.int64)] = rows.iloc[:, 1:].to_numpy()
    return out


def retained(tree: Tree, gain: np.ndarray) -> Tree:
    """Only states that pass the divergence test, and their suffixes."""
    best = gain.argmax(axis=1)
    keep = gain.max(axis=1) >= LEAST_GAIN * np.maximum(tree.count, 1)
    keep[0] = True
    for d in range(int(tree.depth.max(initial=0)), 1, -1):
        keep[tree.parent[keep & (tree.depth == d)]] = True
    # States keep their numbers; one that goes leads to its suffix and is never a context itself.
    depth = np.where(keep, tree.depth, 0)
    to = np.arange(len(keep))
    for _ in range(int(tree.depth.max(initial=0))):
        to = np.where(keep[to], to, tree.parent[to])
    return Tree(tree.symbols, tree.known, tree.keys, tree.states, tree.count, tree.parent, depth,
                np.array(SMOOTHING)[best], tree.tokens, tree.types, to)


def learned(texts: DataFrame, count: int, depth: int = DEPTH) -> Tree:
    tree = first_tree(texts, count)
    for _ in range(depth - 1):
        if tree.tokens:
            tree = extended(texts, count, tree)
    return retained(tree, gains(texts, count, tree))


def asked(tree: Tree, words: np.ndarray, state: np.ndarray, first: np.ndarray, count: int):
    """Distinct (bucket, word, state) of tokens, in order, and which of them each token is."""
    bucket = word_bucket(tree, words, state, first, count)
    order = np.lexsort((state, words, bucket))
    words, state, bucket = words[order], state[order], bucket[order]
    other = np.ones(len(words), bool)
    other[1:] = (words[1:] != words[:-1]) | (bucket[1:] != bucket[:-1])
    new = other.copy()
    new[1:] |= state[1:] != state[:-1]
    which = np.empty(len(words), np.int64)
    which[order] = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    return bucket[at], words[at], state[at], np.flatnonzero(other[at]), which


def tokens_of(tree: Tree, table: pa.Table):
    """(word hash, longest state, row) of every token of the packed texts of a group."""
    out, row = [], 0
    for batch in table.to_batches():
        for t in texts_of(inflated(batch.column("packed"))):
            sequence, at, begin, text = sequences(t)
            out.append((sequence[at], tree.longest[tree.contexts(sequence, at, begin)], text + row + t.first))
        row += batch.num_rows
    return tuple(np.concatenate(x) for x in zip(*out))


def scored(
    docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text", depth: int = DEPTH
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` tells which rows the model learns from; base_score is the log10 probability by word counts
    alone, score that of the suffix tree.

    Texts are dealt over groups of bounded size. A group asks each bucket of words for the counts of its distinct words and
    word-state pairs, handing in its own training counts with the question; a bucket adds these up, and answers in
    the order it was asked. So what travels is a question per distinct pair of a group, not per token.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"),
                       F.coalesce(training, F.lit(False)).alias("training"))
    count = bucket_count(rows, "text", PER_BUCKET)
    tree = learned(rows.where("training").select("text"), count, depth)
    ancestors = tree.ancestors() or [np.zeros(len(tree.count), np.int64)]
    size = len(tree.count)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], deflated(batch.column(3))], names=["grp", "id", "training", "packed"])

    group = F.pmod(F.xxhash64("id", "text", F.monotonically_increasing_id()), F.lit(-(-count // 2))).cast("int")
    texts = rows.select(group.alias("grp"), "id", "training", "text").mapInArrow(
        pack, "grp int, id long, training boolean, packed binary")

    def ask(table: pa.Table) -> pa.Table:
        words, state, row = tokens_of(tree, table)
        learns = table.column("training").to_numpy()
        bucket, words, state, other, which = asked(tree, words, state, ancestors[0], count)
        n = np.bincount(which, weights=learns[row], minlength=len(words)).astype(np.uint32)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        blobs = []
        for a, b in zip(edges[:-1], edges[1:]):
            run = other[np.searchsorted(other, a):np.searchsorted(other, b)]
            blobs.append(squeeze(words[run], np.diff(np.r_[run, b]).astype(np.uint32), state[a:b].astype(np.uint32),
                                 n[a:b]))
        return pa.table({
            "bucket": pa.array(bucket[edges[:-1]], pa.int32()), "entries": pa.array(blobs, pa.binary()),
            "grp": pa.array(np.full(len(blobs), table.column("grp")[0].as_py()), pa.int32())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        current = None

        def replies():
            parts = [expand(blob) for blob, _ in held]
            words = np.concatenate([np.repeat(p[0], p[1]) for p in parts])
            state = np.concatenate([p[2] for p in parts]).astype(np.int64)
            n = np.concatenate([p[3] for p in parts]).astype(np.float64)
            distinct, which = np.unique(words, return_inverse=True)
            c = word_counts(tree, distinct, which, n).astype(np.uint64)
            at_depth = []
            for above in ancestors:
                s = above[state]
                keep = s > 0
                found = np.zeros(len(s), np.uint64)
                if keep.any():
                    _, pair, at = keyed(which[keep] * size + s[keep], n[keep])
                    found[keep] = pair[at]
                at_depth.append(found)
            a = 0
            blobs = []
            for p in parts:
                b = a + len(p[2])
                first = a + np.cumsum(p[1].astype(np.int64)) - p[1]
                blobs.append(squeeze(c[which[first]], *[x[a:b] for x in at_depth]))
                a = b
            return pa.record_batch({
                "grp": pa.array([g for _, g in held], pa.int32()),
                "bucket": pa.array([current] * len(held), pa.int32()), "reply": pa.array(blobs, pa.binary())})

        for batch in batches:
            for b, blob, g in zip(*[c.to_pylist() for c in batch.columns]):
                if b != current and held:
                    yield replies()
                    held = []
                current = b
                held.append((blob, g))
        if held:
            yield replies()

    def finish(table: pa.Table, replies: pa.Table) -> pa.Table:
        words, state, row = tokens_of(tree, table)
        _, _, state, other, which = asked(tree, words, state, ancestors[0], count)
        order = np.argsort(replies.column("bucket").to_numpy())
        blobs = replies.column("reply").to_pylist()
        counts, *at_depth = (np.concatenate(x) for x in zip(*[expand(blobs[k]) for k in order]))
        known = np.repeat(counts, np.diff(np.r_[other, len(state)])).astype(np.float64)
        base = tree.base(known)
        p = base.copy()
        for above, n in zip(ancestors, at_depth):
            s = above[state]
            keep = s > 0
            strength = tree.smoothing[s[keep]]
            p[keep] = (n[keep] + strength * p[keep]) / (tree.count[s[keep]] + strength)
        rows_here = table.num_rows
        add = lambda w: np.bincount(row, weights=w[which], minlength=rows_here)
        return pa.table({
            "doc_id": table.column("id").combine_chunks(),
            "held_out": pa.array(~table.column("training").to_numpy()),
            "n_tokens": pa.array(np.bincount(row, minlength=rows_here)),
            "n_known": pa.array(add(known > 0).astype(np.int64)),
            "base_score": pa.array(add(np.log10(base))), "score": pa.array(add(np.log10(p)))})

    questions = texts.groupBy("grp").applyInArrow(ask, "bucket int, entries binary, grp int")
    answers = by_bucket(questions, count).mapInArrow(answer, "grp int, bucket int, reply binary")
    out = texts.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tree.tokens).cast("long"))
