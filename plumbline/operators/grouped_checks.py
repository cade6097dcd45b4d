"""Group checks: each returns the failing groups of a table, one shuffle each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.frames import scalar
from plumbline.operators.skew import group_apart, key_counts, probe


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """Key values held by several rows; all absent keys form one group."""
    return (
        key_counts(df, [column], "occurrences")
        .where("occurrences > 1")
        .select(F.col(column).alias("record_id"), "occurrences")
    )


def duplicate_records(
    df: DataFrame, columns: list[str], row_filter: str | None = None, wide: bool = False
) -> DataFrame:
    """Groups of rows that agree on all columns.

    With ``wide`` columns (whole texts) a first pass shuffles one hash per row only; the second
    pass reads the rows whose hash occurs twice and groups those by their full values, so that a
    hash collision cannot change the result.
    """
    rows = df.where(row_filter) if row_filter else df
    if wide:
        hashed = rows.select(*columns, F.xxhash64(*columns).alias("__hash"))
        repeated = key_counts(hashed, ["__hash"]).where("n > 1")
        rows = probe(hashed, ["__hash"], repeated, ["__hash"], "left_semi")
    return key_counts(rows, columns, "dup_count").where("dup_count > 1")


def repeated_files(df: DataFrame, column: str, keep_unnamed: bool = False) -> DataFrame:
    rows = df if keep_unnamed else df.where(F.col(column).isNotNull())
    return (
        key_counts(rows, [column], "load_count")
        .where("load_count > 1")
        .select(F.col(column).alias("record_id"), F.col(column).alias("failed_value"), "load_count")
    )


def skewed_values(df: DataFrame, column: str, max_pct: float) -> DataFrame:
    """Values whose unrounded share of all rows exceeds ``max_pct`` percent."""
    share = F.col("group_count") * F.lit(100.0) / F.nullif(scalar(df, F.count(F.lit(1))), F.lit(0))
    return (
        key_counts(df, [column], "group_count")
        .where(share > max_pct)
        .select(F.col(column).alias("failed_value"), "group_count", F.round(share, 2).alias("pct"))
    )


def conflicting_amounts(
    df: DataFrame, date: str, group: str, group_value: str, amount: str
) -> DataFrame:
    """Dates for which one group carries more than one amount.

    Two different amounts exist exactly when the smallest is below the largest, so no
    distinct-count expansion is needed.
    """
    return (
        df.where((F.col(group) == group_value) & F.col(date).isNotNull())
        .groupBy(date, group)
        .agg(
            F.count(F.lit(1)).alias("entry_count"),
            F.min(amount).alias("min_val"),
            F.max(amount).alias("max_val"),
        )
        .where("min_val < max_val")
        .select(
            F.col(date).alias("record_id"), F.col(group).alias("failed_value"),
            "entry_count", "min_val", "max_val",
        )
    )


def near_duplicates(df: DataFrame, columns: list[str], wide: bool = False) -> DataFrame:
    """Records that agree once case, punctuation and spacing are set aside.

    ``wide`` columns are treated as in :func:`duplicate_records`: the first pass normalises every
    row once but shuffles hashes only; the second pass shuffles the rows whose normal form may occur
    twice with their text.
    """
    normal = [
        F.trim(F.regexp_replace(F.lower(F.col(c).cast("string")), r"[^\p{L}\p{N}]+", " ")).alias(c)
        for c in columns
    ]
    rows = df.select(*columns)
    if wide:
        hashes = key_counts(
            rows.select(F.xxhash64(*columns).alias("__hash"), F.xxhash64(*normal).alias("__normal")),
            ["__hash", "__normal"]).where("n > 0")
        repeated = group_apart(hashes, ["__normal"], F.sum("n").alias("rows")).where("rows > 1")
        candidates = hashes.join(repeated, "__normal")
        rows = probe(rows.withColumn("__hash", F.xxhash64(*columns)), ["__hash"], candidates, ["__hash"], "left_semi")
    return (
        key_counts(rows, columns)
        .select(*normal, "n")
        .groupBy(*columns)
        .agg(F.sum("n").alias("dup_count"), F.count(F.lit(1)).alias("spellings"))
        .where("dup_count > 1")
    )
