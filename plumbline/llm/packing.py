"""Documents packed into as few token sequences as can be, by dominance reduction and best fit.

Documents are tokenised whole and end with one separator id; only those longer than a sequence are cut. What is packed
is not the documents but the counts of their lengths: a table of at most ``capacity`` numbers, whatever the input. On it,

* sets that dominate every alternative are fixed first, after Martello and Toth: a long piece that nothing fits beside
  stands alone; with a partner that fills the sequence, or the longest partner where whatever else fits is no longer
  than it, it is a pair; each fixed set shrinks the instance;
* the rest goes by best fit, longest first, into the fullest sequence that has room.

The outcome, so many sequences of one pattern, gives every piece a place by its rank among the pieces of its length.

Null texts are empty: the separator alone. Rows that repeat an id are packed one by one, a null id stays null. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.spark import partitions
from plumbline.llm.texts import texts_of
from plumbline.session import cut_lineage, scratch_path

CAPACITY = 2048
SEPARATOR = 0
# Distinct words whose ids a worker remembers, none longer than so many bytes.
REMEMBERED, LONG_WORD = 500_000, 64
# Punctuation that is looked for behind words, and words on which a tokenizer shows that it parts it from them and
# folds case.
TRAILING = b".,;:!?%&*#$|()"
SHOWN = [w + t for w in (b"word", b"Word", b"WORDS", b"a", b"I", b"x1", b"2024", "\u00c9t\u00e9".encode(), b"antiDis", b"zzqx")
         for t in (b"", *(bytes([c]) for c in TRAILING), b".,", b"!!", b"...", b").", b"%,", b"|", b"$#")]
# Small Latin letters, none of which combines with another or has another small form.
SMALL = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
SMALL_WORD = re.compile(f"[{SMALL}]+")


class Remembered(dict):
    """What ``make`` gives for a word, kept for at most ``limit`` words: those met lately stay when the oldest half goes."""

    def __init__(self, make: Callable[[bytes], bytes], limit: int):
        super().__init__()
        self.make, self.half, self.before = make, limit // 2, {}

    def __missing__(self, word: bytes) -> bytes:
        found = self.before.get(word)
        if found is None:
            found = self.make(word)
        # Long words are not kept, so the memory is bounded by words of ordinary length.
        if len(word) <= LONG_WORD:
            if len(self) >= self.half:
                self.before = dict(self)
                self.clear()
            self[word] = found
        return found


class Encoder:
    """Ids of whole texts, by words: white space bounds tokens in the tokenizers this is used with.

    A word's ids are computed once and remembered; the memory is bounded. Where the tokenizer parts punctuation from
    letters and folds case, as it is asked to show on fixed words, the ids of a word of letters and digits alone, with or
    without punctuation behind, are those of its lower-case body and of the punctuation, and bodies are remembered as well:
    there are far fewer of them. All other words are encoded whole, among them those with marks that combine with a
    letter or with the strings of special tokens.

    Where it shows as well that a word of small Latin letters reaches its model as one piece, letter by letter, such a body is given
    to the model at once, past the steps that prepare texts of any kind.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Remembered(self._of, REMEMBERED)
        self.bodies = Remembered(self._of_body, REMEMBERED)
        self.letters = self._spelled()
        self.direct = bool(self.letters) and all(
            self._by_model(w) == self._ids(w.encode()) for w in (
                *SMALL, *(f"{c}{d}" for c in SMALL for d in SMALL), "internationalisation", SMALL, SMALL[::-1]))
        self.parts = all(self._by_parts(w) == self._ids(w) for w in SHOWN)

    def _ids(self, word: bytes) -> bytes:
        found = self.tokenizer.encode_batch_fast([word.decode()], add_special_tokens=False)
        return array("I", found[0].ids).tobytes()

    def _spelled(self) -> dict[int, str]:
        """How the model is shown each small letter; empty if it is shown no words or a letter in several pieces."""
        split = self.tokenizer.pre_tokenizer
        shown = [split.pre_tokenize_str(c) for c in SMALL] if split else []
        return {ord(c): s[0][0] for c, s in zip(SMALL, shown)} if all(len(s) == 1 for s in shown) else {}

    def _by_model(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word.translate(self.letters))]).tobytes()

    def _of_body(self, body: bytes) -> bytes:
        if not body:
            return b""
        if self.direct and SMALL_WORD.fullmatch(text := body.decode()):
            return self._by_model(text)
        return self._ids(body)

    def _by_parts(self, word: bytes) -> bytes:
        body, tail = parted(word)
        return self.bodies[body] + self.bodies[tail]

    def _of(self, word: bytes) -> bytes:
        return self._by_parts(word) if self.parts and len(word) <= LONG_WORD else self._ids(word)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit numbers."""
        return [b"".join(map(self.known.__getitem__, t.split())) for t in texts]


def parted(word: bytes) -> tuple[bytes, bytes]:
    """The body of a word of letters and digits, A-Z in lower case, and the punctuation behind it; other words whole.

    So are words with a letter whose small form has a mark of its own, which would go with the punctuation.
    """
    body = word.rstrip(TRAILING)
    if body.isalnum() or not body.isascii() and body.decode().lower().isalnum():
        return body.lower(), word[len(body):]
    return word, b""


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) with ids as little-endian unsigned 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            for texts in texts_of(batch.column(1), 2 << 20):
                ids = encoder(tokenizer).encode([texts.text(i) for i in range(len(texts))])
                row, piece, start, cut = [], [], [], []
                for i, x in enumerate(ids):
                    x += end
                    for k, at in enumerate(range(0, len(x), 4 * capacity)):
                        row.append(texts.first + i)
                        piece.append(k)
                        start.append(at // 4)
                        cut.append(x[at:at + 4 * capacity])
                yield pa.record_batch({
                    "doc_id": batch.column(0).take(pa.array(row, pa.int64())),
                    "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                    "length": pa.array([len(c) // 4 for c in cut], pa.int64()), "ids": pa.array(cut, pa.binary())})

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


@dataclass
class Pattern:
    """``bins`` sequences that each hold ``copies`` pieces of each ``length`` listed."""

    parts: tuple[tuple[int, int], ...]
    bins: int


def dominant_sets(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Fix dominating sets, longest piece first, and take them from ``counts`` (by length)."""
    out: list[Pattern] = []
    for j in range(capacity, 0, -1):
        while counts[j]:
            room = capacity - j
            present = np.flatnonzero(counts[:room + 1])
            if not len(present):
                out.append(Pattern(((j, 1),), int(counts[j])))
                counts[j] = 0
                break
            k = int(present[-1])
            if k == j and counts[j] < 2 and len(present) > 1:
                k = int(present[-2])
            elif k == j and counts[j] < 2:
                out.append(Pattern(((j, 1),), 1))
                counts[j] = 0
                break
            if j < k or not (k == room or no_longer_set(counts, present, k, room)):
                break
            n = int(counts[j] // 2 if j == k else min(counts[j], counts[k]))
            out.append(Pattern(((j, 2),) if j == k else ((j, 1), (k, 1)), n))
            counts[j] -= n
            counts[k] -= n
    return out


def no_longer_set(counts: np.ndarray, present: np.ndarray, k: int, room: int) -> bool:
    """No two or more pieces that fit into ``room`` together are longer than ``k``, the longest that fits alone."""
    smallest = []
    for x in present[:3]:
        smallest += [int(x)] * int(min(3, counts[x]))
    if len(smallest) < 2 or smallest[0] + smallest[1] > room:
        return True
    if len(smallest) > 2 and sum(smallest[:3]) <= room:
        return False
    for a in present:
        partners = present[(present >= a) & (present + a <= room) & (present + a > k)]
        if len(partners) and (len(partners) > 1 or partners[0] != a or counts[a] > 1):
            return False
    return True


def best_fit(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest pieces first, each into the fullest sequence with room; alike sequences are filled together."""
    open_: dict[int, list[Pattern]] = defaultdict(list)
    done: list[Pattern] = []
    for length in range(capacity, 0, -1):
        left = int(counts[length])
        for room in [*sorted(r for r in open_ if r >= length), capacity]:
            groups = open_.pop(room, []) if room < capacity else [Pattern((), left)]
            while groups and left:
                group = groups.pop()
                each = room // length
                full = min(group.bins, left // each)
                rest = left - full * each if full < group.bins else 0
                rest = min(rest, each - 1)
                for bins, copies in ((full, each), (1 if rest else 0, rest)):
                    if bins:
                        after = Pattern((*group.parts, (length, copies)), bins)
                        left -= bins * copies
                        space = room - copies * length
                        (open_[space] if space else done).append(after)
                unused = group.bins - full - (1 if rest else 0)
                if unused and room < capacity:
                    groups.append(Pattern(group.parts, unused))
            if groups and room < capacity:
                open_[room] += groups
            if not left:
                break
    return done + [p for groups in open_.values() for p in groups]


def solve(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that hold ``counts[n]`` pieces of each length n."""
    counts = counts.copy()
    fixed = dominant_sets(counts, capacity)
    return fixed + best_fit(counts, capacity)


SLOT = ("rank", "bins", "sequence", "offset")


def slots(patterns: list[Pattern], capacity: int) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, sequences, first sequence, offset) in order of rank."""
    out: dict[int, list] = defaultdict(list)
    used = np.zeros(capacity + 1, np.int64)
    sequence = 0
    for p in patterns:
        offset = 0
        for length, copies in p.parts:
            out[length].append((used[length], p.bins, sequence, offset))
            used[length] += p.bins * copies
            offset += length * copies
        sequence += p.bins
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def packed(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text",
           capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    path = scratch_path(spark, "pieces")
    made = pieces(docs, tokenizer, id_column, text, capacity).withColumn("row", F.monotonically_increasing_id())
    made.write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)
    # At most ``capacity`` rows.
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in made.groupBy("length").count().collect():
        counts[length] = n
    places = slots(solve(counts, capacity), capacity)
    # A frequent length is ranked in shares, and the shares are counted up.
    shares = partitions(spark)
    rows = made.select("row", "length", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int").alias("share"))
    sizes = rows.groupBy("length", "share").count()
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut_lineage(sizes.select(
        "length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "shares")
    own = Window.partitionBy("length", "share").orderBy("row")
    ranked = rows.withColumn("own", F.row_number().over(own) - 1).join(sizes.hint("merge"), ["length", "share"])
    ranked = ranked.select("row", "length", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length):
                table, mine = places[int(n)], np.flatnonzero(length == n)
                slot = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                k = rank[mine] - slot[:, 0]
                sequence[mine] = slot[:, 2] + k % slot[:, 1]
                offset[mine] = slot[:, 3] + k // slot[:, 1] * n
            yield pa.record_batch({"row": batch.column(0), "sequence_id": sequence, "offset": offset})

    placed = ranked.mapInArrow(place, "row long, sequence_id long, offset long")
    return made.join(placed.hint("shuffle_hash"), "row").drop("row")

