"""Order checks on change logs, safe for records that own a large part of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.skew import present


# How much of the order makes one slice: an hour of time, so many units of a number, so many characters of a text.
SLICE_UNITS, SLICE_CHARACTERS = 100_000, 8


def slice_of(df: DataFrame, column: str) -> Column:
    """A value that never decreases along ``column`` and cuts it into slices."""
    kind, value = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc("hour", value)
    if isinstance(kind, T.NumericType):
        return F.floor(value / SLICE_UNITS)
    return F.substring(value.cast("string"), 1, SLICE_CHARACTERS) if isinstance(kind, T.StringType) else value


def with_previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Add ``prev_<column>`` of the preceding row of the same key.

    A window over the keys alone would sort a hot key in one task. A slice of the first order column is part of the
    partitioning instead, which splits hot keys; each slice looks back inside itself, and its first row takes the
    last row of the key's preceding slice, found on one summary row per key and slice. Nothing is written in between.
    """
    slots = df.withColumn("__slot", F.struct(slice_of(df, order[0]).alias("s")))
    inside = Window.partitionBy(*keys, "__slot").orderBy(*order)
    row = F.struct(*columns)
    looked = slots.withColumns({"__prev": F.lag(row).over(inside), "__first": F.row_number().over(inside) == 1})
    ends = slots.groupBy(*keys, "__slot").agg(F.max_by(row, F.struct(*order)).alias("__last"))
    across = Window.partitionBy(*keys).orderBy("__slot")
    carried = ends.select(*keys, "__slot", F.lag("__last").over(across).alias("__carried"))
    joined = looked.join(carried, [*keys, "__slot"], "left")
    previous = F.when(F.col("__first"), F.col("__carried")).otherwise(F.col("__prev"))
    return joined.withColumn("__prev", previous).select(
        *df.columns, *[F.col("__prev")[c].alias(f"prev_{c}") for c in columns]
    )


def order_violations(
    df: DataFrame, keys: list[str], sequence: str, moment: str, operation: str, record_id: str
) -> DataFrame:
    """Changes whose sequence does not grow in time order, and inserts that follow a delete at the
    same sequence number."""
    looked = with_previous(
        present(df, keys), keys, [moment, sequence, record_id], [sequence, operation])
    previous = F.col(f"prev_{sequence}")
    finding = F.when(
        (F.col(sequence) == previous) & (F.col(f"prev_{operation}") == "D") & (F.col(operation) == "I"),
        "DELETE_BEFORE_INSERT",
    ).when(F.col(sequence) <= previous, "NOT_INCREASING")
    return looked.withColumn("finding", finding).where("finding IS NOT NULL").select(
        F.col(record_id).alias("record_id"), *keys, sequence, f"prev_{sequence}", "finding"
    )
