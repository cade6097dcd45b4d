"""Quality rules per document and, by shrunken failure rates, per host.

Each document is measured and judged by five rules in whole numbers. Rule failures are added up by host; a host's
rate of each rule is drawn towards the rate of all hosts by a beta prior whose strength follows, by the method of
moments, from how much the hosts differ. A host with a rate above ``HOST_LIMIT`` is untrusted. A document goes if it
fails a base rule, or if its host is untrusted and it fails any rule: a clean document stays wherever it comes from.

Null texts have no words. Documents without a host are judged by the base rules alone and count for no host.
Empty texts are short. Rows that repeat an id are judged one by one. Whole texts are measured, however long. An empty
table gives an empty result; other columns are ignored unless carried.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.texts import SPACE, Texts, mixed, texts_of, word_bounds, word_hashes
from plumbline.session import cut_lineage

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
HOST_LIMIT = 0.5
# Bounds of the prior's weight in documents: so many that one document condemns no host, and that hosts count as alike.
LEAST_WEIGHT, MOST_WEIGHT = 10.0, 1e6


def rules() -> dict[str, Column]:
    """True where a document fails."""
    n = F.col("n_words")
    return {
        "short": n < 50,
        "repeats": F.col("n_repeat_words") * 100 > n * 50,
        "symbols": F.col("n_symbols") * 10 > n,
        "word_length": (F.col("word_chars") < n * 3) | (F.col("word_chars") > n * 10),
        "lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
    }


BASE = ("short", "repeats")


def per_text(flags: np.ndarray, texts: Texts) -> np.ndarray:
    total = np.r_[0, np.cumsum(flags, dtype=np.int64)]
    return total[texts.offsets[1:]] - total[texts.offsets[:-1]]


def repeated_words(texts: Texts, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window of three words found twice or more in that text."""
    n = len(starts)
    out = np.zeros(len(texts), np.int64)
    if n < 3:
        return out
    h = word_hashes(texts, starts, ends, lower=False)
    window = mixed(mixed(h[:-2]) + h[1:-1] * np.uint64(3)) + h[2:] * np.uint64(5)
    inside = np.flatnonzero(owner[:-2] == owner[2:])
    key = mixed(window[inside] + mixed(owner[inside].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key)
    ordered = key[order]
    same = ordered[1:] == ordered[:-1]
    several = np.r_[False, same] | np.r_[same, False]
    at = inside[order[several]]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[at + k] = True
    return np.bincount(owner[hit], minlength=len(texts)).astype(np.int64)


def measures(texts: Texts) -> list[np.ndarray]:
    starts, ends = word_bounds(texts)
    owner = texts.owner(starts)
    n_words = np.bincount(owner, minlength=len(texts)).astype(np.int64)
    point = ((texts.data & 0xC0) != 0x80) & ~SPACE[texts.data]
    lines = np.zeros((2, len(texts)), np.int64)
    for i in range(len(texts)):
        worded = [x for x in texts.text(i).split(b"\n") if x.strip()]
        lines[:, i] = len(worded), len(worded) - len(set(worded))
    return [n_words, per_text(point, texts), per_text(SYMBOLS[texts.data], texts), lines[0], lines[1],
            repeated_words(texts, starts, ends, owner)]


def measured(docs: DataFrame, text: str, carry: Sequence[Column]) -> DataFrame:
    """The carried columns and the measures of each row's text."""
    rows = docs.select(*carry, F.col(text).cast("string").alias("__text"))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(m, T.LongType()) for m in MEASURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measures(t) for t in texts_of(batch.column(batch.num_columns - 1))]
            made = [pa.array(np.concatenate(x)) for x in zip(*parts)] if parts else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + made, names=schema.names)

    return rows.mapInArrow(run, schema)


def host_rates(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """(host, documents, and the shrunken failure rate of each rule) for every host."""
    found = measured(docs.where(F.col(host).isNotNull()), text, [F.col(host).cast("string").alias("host")])
    failing = rules()
    counts = cut_lineage(found.groupBy("host").agg(
        F.count(F.lit(1)).alias("documents"), *[F.count_if(failing[r]).alias(r) for r in failing]), "hosts")
    n = F.col("documents")
    totals = counts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"),
        *[F.sum(r).alias(f"{r}_sum") for r in failing],
        *[F.sum(F.col(r) * F.col(r) / n).alias(f"{r}_squares") for r in failing]).first()
    shrunk = []
    for r in failing:
        weight, mean = LEAST_WEIGHT, 0.0
        if totals["n"]:
            size, failed = float(totals["n"]), float(totals[f"{r}_sum"])
            mean = failed / size
            spread = mean * (1 - mean)
            # Between hosts, less what chance within hosts of their sizes makes.
            between = totals[f"{r}_squares"] - failed * mean - (totals["hosts"] - 1) * spread
            room = size - totals["squares"] / size
            weight = spread * room / between - 1 if between > 0 and room > 0 else MOST_WEIGHT
            weight = min(max(weight, LEAST_WEIGHT), MOST_WEIGHT)
        shrunk.append(((F.col(r) + F.lit(weight * mean)) / (F.col("documents") + F.lit(weight))).alias(r))
    return counts.select("host", "documents", *shrunk)


def judged(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", carry: Sequence[str] = (),
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, the carried columns, the measures, base_failed, host_rejected, kept."""
    rates = host_rates(docs, text, host)
    worst = F.greatest(*[F.col(r) for r in rules()]) if rules() else F.lit(0.0)
    untrusted = cut_lineage(rates.where(worst > HOST_LIMIT).select(F.col("host").alias("__untrusted")), "untrusted")
    rows = measured(docs, text, [
        F.col(id_column).alias("__id"), F.col(host).cast("string").alias("__host"),
        *[F.col(c).alias(f"__c{k}") for k, c in enumerate(carry)]])
    rows = rows.join(untrusted, rows["__host"] == untrusted["__untrusted"], "left")
    failing = rules()
    base = failing[BASE[0]] | failing[BASE[1]]
    any_rule = base
    for r in failing:
        any_rule = any_rule | failing[r]
    rejected = F.col("__untrusted").isNotNull()
    return rows.select(
        F.col("__id").alias("doc_id"), *[F.col(f"__c{k}").alias(c) for k, c in enumerate(carry)], *MEASURES,
        base.alias("base_failed"), rejected.alias("host_rejected"), (~base & ~(rejected & any_rule)).alias("kept"))
