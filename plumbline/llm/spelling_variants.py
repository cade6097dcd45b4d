"""Spelling variants: words one edit apart, and the commoner form that each leads to.

Words within one edit share their first or their last half: the edit lies in one of them. So each word is dealt to groups
by the halves that it has in common with words of its own length and one more or less, and each group is a sorted list, by
the reversed words where the last half is shared.

In a group ``near_in_list`` scans the list once. The edit matrix of a list word against all words of the group is kept
as a stack of rows, each a band of three diagonals: rows of the prefix a word shares with the one before it are used again, and
if a row has no entry of at most one edit, all words that share the prefix up to there are skipped.

A group larger than ``SHARE`` is cut into shares, and each pair of shares is a group, so no task holds a group whole. Word
counts are added up before they are shuffled. Links of a word with very many near words are counted and reduced the same way.

A null text has no words. A null document id is written as an empty string where ids matter. Repeated rows count again.
Columns of other names are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.line_dedup import CAPITALS
from plumbline.session import cut_lineage

MIN_LENGTH, MIN_COUNT = 5, 3
# Words of a group that one task scans against each other at once.
SHARE = 4096
FAR = 9


def lowered(run: Column) -> Column:
    """Only A-Z in lower case."""
    plain = F.octet_length(run) == F.length(run)
    return F.when(plain, F.lower(run)).otherwise(F.translate(run, CAPITALS, CAPITALS.lower()))


def word_counts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
    every: int = 97,
) -> DataFrame:
    """(word, n): runs of letters, of which one in ``every`` is given an error of one missing character.

    Which run and which character follow from the crc32 of the document's id and the run. Shorter runs cannot become
    words, so they are not matched at all.
    """
    runs = docs.select(
        F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-zÀ-ÿ]{{{min_length},}}"), F.lit(0))).alias("run"))
    run = runs.select("id", lowered(F.col("run")).alias("run")).withColumn(
        "h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = run.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))
    words = words.where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def halves(words: DataFrame) -> DataFrame:
    """(m, back, key, word, n): the groups of each word.

    Group m holds words of m and m + 1 characters, which agree in their first m // 2 or, reversed (``back``), in the rest.
    """
    size, rest = F.length("word"), F.col("m") - F.floor(F.col("m") / 2).cast("int")
    each = words.withColumn("m", F.explode(F.array(size, size - 1))).withColumn("back", F.explode(F.array(F.lit(False), F.lit(True))))
    turned = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    shared = F.when(F.col("back"), rest).otherwise(F.col("m") - rest)
    return each.select("m", "back", turned.alias("word"), "n", shared.alias("shared")).withColumn(
        "key", F.substring("word", F.lit(1), F.col("shared"))).select("m", "back", "key", "word", "n")


def near_in_list(codes: np.ndarray, lengths: np.ndarray, queries: np.ndarray, shared: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, rows) for each list word k that is one edit or none from ``rows`` of the ``queries``.

    ``codes`` are the sorted list's code points, one word a row, padded with zeros; all begin with the same ``shared``
    ones, as do the queries, whose words are all equally long. A list word has that length or one more.
    """
    n, m = len(codes), queries.shape[1]
    differ = codes[1:] != codes[:-1]
    common = np.r_[0, np.where(differ.any(axis=1), differ.argmax(axis=1), codes.shape[1])]
    everyone = np.arange(len(queries))
    # Row ``shared``: distance of the shared prefix to a query's prefix one shorter, equal and one longer.
    rows = [(everyone, np.ones(len(queries), np.int8), np.zeros(len(queries), np.int8), np.ones(len(queries), np.int8))]
    dead = m + 2
    for k in range(n):
        if k and common[k] >= dead:
            continue
        del rows[max(common[k] - shared, 0) + 1:]
        dead = m + 2
        for j in range(shared + len(rows) - 1, lengths[k]):
            at, lo, mid, hi = rows[-1]
            c = codes[k, j]
            # Columns j, j + 1 and j + 2 of the next row; a column beyond the query's end is far.
            low = np.minimum(lo + (queries[at, j - 1] != c), mid + 1) if j <= m else np.full(len(at), FAR, np.int8)
            here = np.minimum(np.minimum(mid + (queries[at, j] != c), hi + 1), low + 1) if j < m else np.full(len(at), FAR, np.int8)
            high = np.minimum(hi + (queries[at, j + 1] != c), here + 1) if j + 1 < m else np.full(len(at), FAR, np.int8)
            alive = (low <= 1) | (here <= 1) | (high <= 1)
            if not alive.any():
                dead = j + 1
                break
            rows.append((at[alive], low[alive], here[alive], high[alive]))
        else:
            at, lo, mid, _ = rows[-1]
            near = at[(mid if lengths[k] == m else lo) <= 1]
            if len(near):
                yield k, near


def code_points(words: list[str], width: int) -> np.ndarray:
    return np.frombuffer(
        "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(len(words), width)


def group_links(m: int, back: bool, rows: list[tuple[str, int, bool, bool]]) -> list[tuple[str, str, int]]:
    """(word, near word, its count) among rows (word, n, is a query, is in the list) of one group, sorted by word."""
    listed = [(w, n) for w, n, _, inside in rows if inside]
    asked = [(w, n) for w, n, query, _ in rows if query and len(w) == m]
    if not asked or not listed:
        return []
    half = m // 2
    shared = m - half if back else half
    lengths = np.array([len(w) for w, _ in listed])
    codes, queries = code_points([w for w, _ in listed], m + 1), code_points([w for w, _ in asked], m)
    out = []
    for k, near in near_in_list(codes, lengths, queries, shared):
        word, n = listed[k]
        b = word[::-1] if back else word
        for i in near.tolist():
            other, count = asked[i]
            a = other[::-1] if back else other
            # Words that also share their first half have met there.
            if a == b or back and a[:half] == b[:half]:
                continue
            out.append((a, b, n))
            if len(b) > m:
                out.append((b, a, count))
    return out


def near_words(words: DataFrame, share: int = SHARE) -> DataFrame:
    """(word, near, n): every ordered pair of words one edit apart, once, with the near word's count.

    ``words`` are distinct (word, n).
    """
    entries = halves(words)
    group = ["m", "back", "key"]
    large = entries.groupBy(*group).count().where(F.col("count") > share)
    large = cut_lineage(large.select(*group, F.ceil(F.col("count") / share).cast("int").alias("shares")), "shares")
    yes, no = F.lit(True), F.lit(False)
    if large.isEmpty():
        entries = entries.select(*group, F.lit(0).alias("i"), F.lit(0).alias("j"), "word", "n", yes.alias("asks"), yes.alias("listed"))
    else:
        # Share s asks in the groups (s, t) and is listed in the groups (t, s).
        entries = entries.join(large, group, "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        entries = entries.withColumn("s", F.pmod(F.xxhash64("word"), F.col("shares")).cast("int")).withColumn(
            "t", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        asking = F.struct(F.col("s").alias("i"), F.col("t").alias("j"), yes.alias("asks"), (F.col("s") == F.col("t")).alias("listed"))
        listed = F.struct(F.col("t").alias("i"), F.col("s").alias("j"), no.alias("asks"), yes.alias("listed"))
        both = F.when(F.col("s") == F.col("t"), F.array(asking)).otherwise(F.array(asking, listed))
        entries = entries.select(*group, "word", "n", F.explode(both).alias("g")).select(*group, "g.i", "g.j", "word", "n", "g.asks", "g.listed")
    order = [*group, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        found: list[tuple[str, str, int]] = []

        def packed() -> pa.RecordBatch:
            a, b, n = zip(*found)
            return pa.record_batch({"word": pa.array(a, pa.string()), "near": pa.array(b, pa.string()), "n": pa.array(n, pa.int64())})

        for batch in batches:
            for m, back, key, i, j, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (m, back, key, i, j) != current:
                    if len(held) > 1:
                        found += group_links(current[0], current[1], held)
                        if len(found) > 50_000:
                            yield packed()
                            found.clear()
                    current, held = (m, back, key, i, j), []
                held.append(tuple(row))
        if len(held) > 1:
            found += group_links(current[0], current[1], held)
        if found:
            yield packed()

    dealt = entries.select(*order, "word", "n", "asks", "listed").repartition(*order).sortWithinPartitions(*order, "word")
    return dealt.mapInArrow(run, "word string, near string, n long")


def variants(words: DataFrame, ratio: int = 2, share: int = SHARE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for distinct (word, n).

    The form is the commonest near word, the smaller one among equals, if it occurs at least ``ratio`` times as often. The
    root is where forms lead in the end; pointers are doubled, so that a chain of forms takes the logarithm of its length.
    """
    links = near_words(words, share).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("rank"), F.col("near").alias("near"))).alias("best"))
    found = words.join(links, "word", "left")
    common = -F.col("best.rank") >= ratio * F.col("n")
    found = cut_lineage(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best.near")).alias("form"),
        F.when(common, -F.col("best.rank")).alias("form_n")), "forms")
    leads = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    moved = True
    while moved:
        leads = cut_lineage(leads, "leads")
        ahead = leads.select(F.col("word").alias("root"), F.col("root").alias("further"))
        leads = cut_lineage(leads.join(ahead, "root", "left"), "ahead")
        moved = not leads.where("further IS NOT NULL").isEmpty()
        leads = leads.select("word", F.coalesce("further", "root").alias("root"))
    return found.join(leads, "word", "left").withColumn("root", F.coalesce("root", "word"))
