"""Small frame builders that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def literal_frame(spark: SparkSession, rows: Sequence[Sequence], schema: T.StructType) -> DataFrame:
    """Configuration-sized rows as a plan of literals: no Python worker, no shuffle."""
    if not rows:
        return spark.createDataFrame([], schema)
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, schema.fields)])
        for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*structs)))


def empty_like(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def scalar(df: DataFrame, expr) -> "F.Column":
    """One aggregate of ``df`` as an uncorrelated scalar subquery."""
    return df.agg(expr.alias("v")).scalar()
