"""Columns known by their content: small samples of their values that tell how much two columns have in common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 256
ALIKE = 0.5


def column_sketches(df: DataFrame, size: int = SAMPLE) -> DataFrame:
    """(column_name, position, sketch): the ``size`` smallest hashes of the distinct values of each column, as text.

    Only hashes below a bound are shuffled, of which an estimate of the number of values says that some eight times as
    many are left as are kept; a column with fewer values keeps all.
    """
    names = df.columns
    texts = [F.col(f"`{c}`").cast("string") for c in names]
    seen = df.agg(*[F.approx_count_distinct(t).alias(f"d{i}") for i, t in enumerate(texts)]).first()
    entries = []
    for i, text in enumerate(texts):
        share = min(1.0, 8 * size / max(1, seen[f"d{i}"]))
        bound = 2**63 - 1 if share == 1 else int(-2**63 + share * 2**64)
        h = F.xxhash64(text)
        entries.append(F.when(text.isNotNull() & (h <= F.lit(bound).cast("long")), F.struct(F.lit(i).alias("i"), h.alias("h"))))
    kept = df.select(F.explode(F.array(*entries)).alias("e")).where("e IS NOT NULL").select("e.i", "e.h").distinct()
    order = Window.partitionBy("i").orderBy("h")
    smallest = kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    sketches = smallest.groupBy("i").agg(F.array_sort(F.collect_list("h")).alias("sketch"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column_name string")
    return listed.join(sketches, "i", "left").select(
        "column_name", (F.col("i") + 1).alias("position"),
        F.coalesce("sketch", F.array().cast("array<long>")).alias("sketch"))


def similarity(a: Column, b: Column, size: int = SAMPLE) -> Column:
    """Share of common values among all values of two columns, judged by the smallest hashes of both together."""
    both = F.slice(F.array_sort(F.array_union(a, b)), 1, size)
    return F.coalesce(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.nullif(F.size(both), F.lit(0)), F.lit(0.0))


def renamed_by_content(before: DataFrame, now: DataFrame, least: float = ALIKE) -> DataFrame:
    """(old_name, new_name, kind, similarity) from two frames of sketches of one table.

    Each old column is given to one new column at most, the most alike first, one of the same name first among equals.
    RENAMED columns have lost their old name, SWAPPED ones bear the name of another that is still there, MOVED ones
    a new name while the old one has other content. The pairs of columns, as many as a schema has, are assigned on the driver.
    """
    old = before.select(F.lit(0).alias("t"), F.col("column_name").alias("old_name"), F.col("sketch").alias("a"))
    new = now.select(F.lit(0).alias("t"), F.col("column_name").alias("new_name"), F.col("sketch").alias("b"))
    pairs = old.join(new, "t").select("old_name", "new_name", similarity(F.col("a"), F.col("b")).alias("s")).where(
        F.col("s") >= least).collect()
    names = [{r.column_name for r in df.select("column_name").collect()} for df in (before, now)]
    taken: tuple[set, set] = (set(), set())
    found = []
    for r in sorted(pairs, key=lambda r: (-r.s, r.old_name != r.new_name, r.old_name, r.new_name)):
        if r.old_name in taken[0] or r.new_name in taken[1]:
            continue
        taken[0].add(r.old_name)
        taken[1].add(r.new_name)
        if r.old_name != r.new_name:
            kind = "RENAMED" if r.old_name not in names[1] else "SWAPPED" if r.new_name in names[0] else "MOVED"
            found.append((r.old_name, r.new_name, kind, r.s))
    return before.sparkSession.createDataFrame(found, "old_name string, new_name string, kind string, similarity double")
