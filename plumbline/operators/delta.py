"""Changes between two versions of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

INSERT, DELETE, BEFORE, AFTER = "INSERT", "DELETE", "UPDATE_BEFORE", "UPDATE_AFTER"


def _marks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Two hashes for each row, by which rows are compared without moving them."""
    return df.withColumns({"__h1": F.xxhash64(*columns), "__h2": F.xxhash64(F.lit(1), *columns)})


def _differing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, __h1, __h2, __net): the rows whose number of copies differs.

    Equal rows of the two versions cancel inside one grouped sum, before and after the shuffle, so copies of one row
    cost nothing and no row is ever paired with another. Only keys and hashes are shuffled.
    """
    columns = old.columns
    marked = [
        _marks(df.select(*columns), columns).select(*keys, "__h1", "__h2", F.lit(sign).alias("__sign"))
        for df, sign in ((old, -1), (new, 1))]
    return marked[0].unionByName(marked[1]).groupBy(*keys, "__h1", "__h2").agg(
        F.sum("__sign").alias("__net")).where("__net <> 0")


def _same(names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in names])


def _whole(differing: DataFrame, old: DataFrame, new: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    """The full rows of what differs, each once however many copies there are."""
    columns = old.columns
    parts = []
    for df, side in ((old, F.col("__net") < 0), (new, F.col("__net") > 0)):
        wanted = differing.where(side).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__h1").alias("__w1"),
                                              F.col("__h2").alias("__w2"), "__net", *extra)
        match = (F.col("__h1") == F.col("__w1")) & (F.col("__h2") == F.col("__w2"))
        if keys:
            match = match & _same(keys)
        rows = _marks(df.select(*columns), columns).join(wanted, match)
        parts.append(rows.groupBy("__h1", "__h2", *columns).agg(
            F.first("__net").alias("__net"), *[F.first(c).alias(c) for c in extra]).drop("__h1", "__h2"))
    return parts[0].unionByName(parts[1])


def net_changes(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Whole rows that were added or taken away, with how many copies.

    Rows are compared by two 64-bit hashes; only those that differ are fetched whole. ``keys`` spread them.
    """
    keys = keys or []
    return _whole(_differing(old, new, keys), old, new, keys, []).select(
        *old.columns, F.when(F.col("__net") > 0, INSERT).otherwise(DELETE).alias("action"), F.abs("__net").alias("row_count"))


def _kinds(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """What differs, written once, with ``is_update``: the key has rows taken away and rows added.

    Keys are folded before they are shuffled, so that very many rows under one key do not meet in a task.
    """
    differing = cut_lineage(_differing(old, new, keys), "differing")
    sides = differing.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        ((F.min("__net") < 0) & (F.max("__net") > 0)).alias("is_update"))
    return differing.join(sides, _same(keys)).select(*keys, "__h1", "__h2", "__net", "is_update")


def change_feed(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Net inserts and deletes; a key with both is an update, shown as its old and new row."""
    return _whole(_kinds(old, new, keys), old, new, keys, ["is_update"]).select(
        *old.columns, F.when(F.col("__net") > 0, INSERT).otherwise(DELETE).alias("action"), "is_update",
        F.abs("__net").alias("row_count"))


def change_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changes as a log keeps them: ``change_type`` INSERT, DELETE, UPDATE_BEFORE or UPDATE_AFTER, and ``change_count`` of
    equal rows."""
    added = F.col("__net") > 0
    kind = F.when(F.col("is_update"), F.when(added, AFTER).otherwise(BEFORE)).when(added, INSERT).otherwise(DELETE)
    return _whole(_kinds(old, new, keys), old, new, keys, ["is_update"]).select(
        *old.columns, kind.alias("change_type"), F.abs("__net").alias("change_count"))


def change_summary(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys by kind of change; whole rows are not needed for that."""
    kind = F.when(F.col("is_update"), "UPDATE").when(F.col("__net") > 0, INSERT).otherwise(DELETE)
    return (
        _kinds(old, new, keys).where("NOT is_update OR __net > 0")
        .groupBy(kind.alias("change_type")).agg(F.sum(F.abs("__net")).alias("row_count"))
    )
