"""Profiles that are carried on: a mergeable state for each part of a table, so that only parts that changed are read.

A part may be a day, a month or whatever a column expression names. Counts, extremes and totals of parts add up exactly;
distinct counts and medians come from sketches that are merged (HyperLogLog, KLL), with the error the functions state.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.profiling import as_text, is_numeric, is_supported, located
from plumbline.sources.store import ResultStore

# Standard error of a merged distinct count (12 bits of buckets), and of the rank of a merged median (k = 200).
DISTINCT_ERROR, RANK_ERROR = 0.0163, 0.0133


def profile_states(df: DataFrame, part: Column) -> DataFrame:
    """One row for each part and column, from one scan; a shuffle carries one row for each task and part."""
    fields = [f for f in df.schema.fields if is_supported(f.dataType)]
    aggregates: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        value = as_text(f.name, f.dataType)
        aggregates += [
            F.count(f.name).alias(f"filled{i}"), F.min(value).alias(f"min{i}"), F.max(value).alias(f"max{i}"),
            F.min(f.name).alias(f"low{i}"), F.max(f.name).alias(f"high{i}"), F.hll_sketch_agg(value).alias(f"hll{i}"),
        ]
        if is_numeric(f.dataType):
            number = F.col(f.name).cast("double")
            aggregates += [F.sum(number).alias(f"total{i}"), F.kll_sketch_agg_double(number).alias(f"kll{i}")]
    rows = [F.struct(
        F.lit(f.name).alias("column_name"), F.lit(f.dataType.typeName()).alias("data_type"), F.col("rows").alias("row_count"),
        (F.col("rows") - F.col(f"filled{i}")).alias("null_count"), F.col(f"min{i}").alias("min_value"),
        F.col(f"max{i}").alias("max_value"), as_text(f"low{i}", f.dataType).alias("typed_min"),
        as_text(f"high{i}", f.dataType).alias("typed_max"),
        (F.col(f"total{i}") if is_numeric(f.dataType) else F.lit(None).cast("double")).alias("total"),
        F.col(f"hll{i}").alias("distinct_sketch"),
        (F.col(f"kll{i}") if is_numeric(f.dataType) else F.lit(None).cast("binary")).alias("rank_sketch"),
    ) for i, f in enumerate(fields)]
    return df.groupBy(part.cast("string").alias("part")).agg(*aggregates).select("part", F.inline(F.array(*rows)))


def merged_profile(states: DataFrame, schema: T.StructType) -> DataFrame:
    """The profile of a table of which ``states`` holds all parts, one row for each column of ``schema``.

    ``distinct_count`` and ``median`` are estimates, all else is exact up to the rounding of sums.
    """
    fields = [f for f in schema.fields if is_supported(f.dataType)]
    aggregates: list[Column] = []
    for i, f in enumerate(fields):
        def own(name: str, f=f) -> Column:
            return F.when(F.col("column_name") == f.name, F.col(name))

        aggregates += [
            F.sum(own("row_count")).alias(f"rows{i}"), F.sum(own("null_count")).alias(f"nulls{i}"),
            F.min(own("min_value")).alias(f"min{i}"), F.max(own("max_value")).alias(f"max{i}"),
            F.min(own("typed_min").cast(f.dataType)).alias(f"low{i}"), F.max(own("typed_max").cast(f.dataType)).alias(f"high{i}"),
            F.hll_union_agg(own("distinct_sketch")).alias(f"hll{i}"),
        ]
        if is_numeric(f.dataType):
            aggregates += [F.sum(own("total")).alias(f"total{i}"), F.kll_merge_agg_double(own("rank_sketch")).alias(f"kll{i}")]
    rows = []
    for i, f in enumerate(fields):
        filled = F.col(f"rows{i}") - F.col(f"nulls{i}")
        mean = median = F.lit(None).cast("double")
        if is_numeric(f.dataType):
            mean = F.round(F.col(f"total{i}") / F.nullif(filled, F.lit(0)), 4)
            median = F.when(filled > 0, F.kll_sketch_get_quantile_double(F.col(f"kll{i}"), F.lit(0.5)))
        rows.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(f.dataType.typeName()).alias("data_type"),
            F.coalesce(f"rows{i}", F.lit(0)).alias("row_count"), F.coalesce(f"nulls{i}", F.lit(0)).alias("null_count"),
            F.round(F.col(f"nulls{i}") * F.lit(100.0) / F.nullif(F.col(f"rows{i}"), F.lit(0)), 4).alias("null_pct"),
            F.coalesce(F.hll_sketch_estimate(f"hll{i}"), F.lit(0)).alias("distinct_count"),
            F.col(f"min{i}").alias("min_value"), F.col(f"max{i}").alias("max_value"),
            as_text(f"low{i}", f.dataType).alias("typed_min"), as_text(f"high{i}", f.dataType).alias("typed_max"),
            mean.alias("mean"), median.alias("median")))
    return states.agg(*aggregates).select(F.inline(F.array(*rows)))


def carry_on(
    store: ResultStore, df: DataFrame, part: Column, table: str, moment: dt.datetime, catalog: str = "main",
    namespace: str = "public",
) -> None:
    """Profile the parts that occur in ``df`` anew and store them in place of what they held before."""
    store.replace("profile_states", located(profile_states(df, part), table, moment, catalog=catalog, namespace=namespace))


def carried_profile(
    store: ResultStore, schema: T.StructType, table: str, catalog: str = "main", namespace: str = "public"
) -> DataFrame:
    """The profile of all stored parts of a table; the table itself is not read."""
    states = store.read("profile_states").where(
        (F.col("database_name") == catalog) & (F.col("schema_name") == namespace) & (F.col("table_name") == table))
    return merged_profile(states, schema)
