"""Benchmark passages in documents, found by spaced seeds and verified with tolerance for replaced words.

A seed is a fixed mask over consecutive words: the words under its ones are hashed, those under its zeros may differ.
The hashes of all windows of a document meet those of the benchmark in a join. At a hit the whole item is laid
along the document, equal words add one and replaced words take ``PENALTY`` off, and the best stretch decides.
Everything runs on DataFrame functions.

Words are runs of letters and digits, in lower case. Items of fewer than ``SHORT`` words have masks of their own length, which
leave out every third word in turn, so that one replaced word, wherever it is, is under a zero of one of them; items too
short to be accepted with a replaced word are sought whole. Those of fewer than ``LEAST_ITEM`` words are too common to
tell anything and match nothing.
Items with the same words are one class, named by the smallest id. Null texts match nothing.
Copies and repeated passages are found in each document; repeated rows of one id give one result. Empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

# Eight or seven words each; a replaced word in an item of ``SHORT`` words or more spoils some windows but not all.
MASKS = ("1111001111", "11011011011", "1010110111")
PENALTY = 2
# Words a stretch must be worth; a shorter item must be there whole, but for one word in ``SPARE``.
LEAST = 10
SPARE = 8
LEAST_ITEM = 5
SHORT = 12
# Benchmark seeds are broadcast up to so many bytes, their items included.
BROADCAST_BYTES = 50_000_000


def word_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def masks_of(words: int) -> list[str]:
    """Masks for items of so many words, fewer than ``SHORT``."""
    if words < SPARE:
        return ["1" * words]
    return ["".join("0" if k % 3 == out else "1" for k in range(words)) for out in range(3)]


def windows(rows: DataFrame, masks: list[str], keep: list[str]) -> DataFrame:
    """(keep, hashes, at, seed) for each mask at each place where it fits into ``hashes``."""
    hashes, at = F.col("hashes"), F.col("at")
    shortest = min(len(m) for m in masks)
    starts = F.when(F.size(hashes) >= shortest, F.sequence(F.lit(0), F.size(hashes) - shortest))
    placed = rows.select(*keep, "hashes", F.explode(starts).alias("at"))
    seeds = []
    for number, mask in enumerate(masks):
        parts = [F.get(hashes, at + k) for k, bit in enumerate(mask) if bit == "1"]
        seed = F.xxhash64(F.lit(number), *parts)
        seeds.append(seed if len(mask) == shortest else F.when(at + len(mask) <= F.size(hashes), seed))
    return placed.select(*keep, "hashes", "at", F.explode(F.array(*seeds)).alias("seed")).where("seed is not null")


def best_stretch(words: Column, item: Column) -> Column:
    """The most that a run of aligned words is worth."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, equal: Column) -> Column:
        run = F.greatest(F.lit(0), acc["run"] + F.when(equal, 1).otherwise(-PENALTY))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.zip_with(words, item, lambda a, b: F.coalesce(a == b, F.lit(False))), zero, step)["best"]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, items, matched, score): documents that hold a passage of a benchmark item.

    items is the number of benchmark rows in the item's class, matched the aligned equal words and score the best
    stretch, each at the best place.
    """
    items = (
        benchmark.select(F.col(item_id).alias("item_id"), word_hashes(F.col(item_text)).alias("hashes"))
        .where(F.size("hashes") >= LEAST_ITEM).groupBy("hashes")
        .agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("items")))
    items = cut_lineage(items.where("item_id is not null"), "benchmark")
    short = sorted(r[0] for r in items.where(F.size("hashes") < SHORT).select(F.size("hashes")).distinct().collect())
    masks = [*MASKS, *[m for n in short for m in masks_of(n)]]
    index = cut_lineage(
        windows(items, masks, ["item_id", "items"]).select(
            "seed", F.col("at").alias("item_at"), "item_id", "items", F.col("hashes").alias("item")), "seeds")
    found = windows(
        docs.select(F.col(id_column).alias("doc_id"), word_hashes(F.col(text)).alias("hashes")), masks, ["doc_id"])
    size = index.agg(F.sum(F.size("item") * 8 + 64)).first()[0] or 0
    side = F.broadcast(index) if size <= BROADCAST_BYTES else index
    hits = found.join(side, "seed")
    shift = F.col("at") - F.col("item_at")
    begin = F.greatest(shift, F.lit(0))
    length = F.least(F.size("item") + shift, F.size("hashes")) - begin
    hits = hits.select(
        "doc_id", "item_id", "items", "item", shift.alias("shift"),
        F.slice("hashes", begin + 1, length).alias("words"), F.slice("item", begin - shift + 1, length).alias("part"))
    # A passage is hit at many places but laid out once.
    places = hits.groupBy("doc_id", "item_id", "items", "shift", "words", "part").agg(
        F.first(F.size("item")).alias("size"))
    equal = F.zip_with("words", "part", lambda a, b: (a == b).cast("int"))
    matched = F.aggregate(equal, F.lit(0), lambda a, b: a + b)
    judged = places.select(
        "doc_id", "item_id", "items", "size", matched.alias("matched"),
        best_stretch(F.col("words"), F.col("part")).alias("score"))
    needed = F.least(F.lit(LEAST), F.col("size") - (PENALTY + 1) * F.floor(F.col("size") / SPARE))
    return (
        judged.where(F.col("score") >= F.greatest(needed, F.lit(1)))
        .groupBy("doc_id", "item_id").agg(
            F.max("items").alias("items"), F.max("matched").cast("long").alias("matched"),
            F.max("score").cast("long").alias("score")))

