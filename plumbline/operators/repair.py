"""Table repairs as transforms; the input is never overwritten."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.operators.skew import group_apart, present, probe


def update_where(df: DataFrame, predicate: Column, changes: Mapping[str, Column]) -> DataFrame:
    """Assign columns of the rows for which the predicate is TRUE; all right-hand sides see old values."""
    hit = F.coalesce(predicate, F.lit(False))
    return df.select(*[
        F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c)
        for c in df.columns
    ])


def insert_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Append rows; columns they lack become NULL."""
    return df.unionByName(rows, allowMissingColumns=True).select(*df.columns)


def _one_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows themselves if no key repeats; otherwise the job stops with an error naming the key."""
    rest = [c for c in rows.columns if c not in keys]
    message = F.concat(F.lit("input repeats key "), F.to_json(F.struct(*keys)))
    return (
        group_apart(rows, keys, F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*rest)).alias("__row"))
        .where(F.when(F.col("__n") > 1, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))
        .select(*[F.col(k) if k in keys else F.col("__row")[k].alias(k) for k in rows.columns])
    )


def merge_rows(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace rows with the same key and add the others; an absent key matches nothing.

    Several new rows for one key have no defined outcome: the job stops with an error naming it.
    """
    keyed = present(rows, keys)
    unkeyed = rows.where(" OR ".join(f"`{k}` IS NULL" for k in keys))
    fresh = _one_per_key(keyed, keys)
    kept = probe(df, keys, keyed, keys, "left_anti")
    return (
        kept.unionByName(fresh, allowMissingColumns=True)
        .unionByName(unkeyed, allowMissingColumns=True)
        .select(*df.columns)
    )


def add_column(df: DataFrame, name: str, data_type: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast(data_type))


def replace_values(df: DataFrame, new_values: DataFrame, key: str, column: str) -> DataFrame:
    """Take ``column`` from ``new_values`` where a row there has the same key, which must not repeat."""
    side = _one_per_key(present(new_values.select(F.col(key), F.col(column).alias("__new")), [key]), [key])
    return df.join(side, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new").select(*df.columns)


def replace_by_key(existing: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: all existing rows of the affected keys give way to the new rows."""
    return probe(existing, keys, rows, keys, "left_anti").unionByName(rows)


def observed_update(
    df: DataFrame, predicate: Column, changes: Mapping[str, Column], name: str = "repair"
) -> tuple[DataFrame, Observation]:
    """The update, and an observation that holds the number of changed rows once it was written."""
    seen = Observation(name)
    counted = df.observe(seen, F.count_if(predicate).alias("changed_rows"))
    return update_where(counted, predicate, changes), seen
