"""Metric forms of the checks: one-row measures and grouped counts instead of failing rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.frames import scalar
from plumbline.functions import predicates as p
from plumbline.operators.skew import key_counts, probe


def missing_ratio(df: DataFrame, column: str) -> DataFrame:
    """Absent or blank values, as count and percentage."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(p.is_blank(F.col(column))).alias("null_count"),
    )
    share = F.col("null_count") / F.nullif(F.col("total_rows"), F.lit(0)) * 100
    return counts.withColumn("null_pct", F.round(share, 2))


def type_violations(df: DataFrame, column: str, expected_type: str) -> DataFrame:
    return df.where(p.has_wrong_type(F.col(column), expected_type)).select(
        F.col(column), F.typeof(column).alias("actual_type")
    )


def domain_violations(df: DataFrame, column: str, allowed: list) -> DataFrame:
    return key_counts(df.where(p.is_outside_domain(F.col(column), allowed)), [column], "cnt")


def rule_breaches(df: DataFrame, rule: str, columns: list[str] | None = None) -> DataFrame:
    """Rows for which the rule, which names what must *hold*, is FALSE; an unknown rule passes."""
    rows = df.where(~F.expr(rule))
    return rows.select(*columns) if columns else rows


def out_of_range_reasons(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.where(p.is_out_of_range(F.col(column), low, high)).select(
        column, F.lit("OUT_OF_RANGE").alias("reason")
    )


def staleness_minutes(df: DataFrame, column: str, as_of: dt.datetime) -> DataFrame:
    """Whole-minute boundaries between the newest row and ``as_of``."""
    newest = F.date_trunc("minute", F.max(column))
    now = F.date_trunc("minute", p.as_of_column(as_of))
    return df.agg(F.timestamp_diff("MINUTE", newest, now).alias("staleness_minutes"))


def completeness(df: DataFrame, column: str) -> DataFrame:
    filled = F.when(F.col(column).isNotNull(), 100.0).otherwise(0.0)
    return df.agg(F.round(F.avg(filled), 2).alias("completeness_pct"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("current_count"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Every value with its count and percentage, most frequent first."""
    total = scalar(df, F.count(F.lit(1)))
    return (
        key_counts(df, [column], "freq")
        .withColumn("pct", F.round(F.col("freq") * F.lit(100.0) / total, 2))
        .orderBy(F.desc("freq"), column)
    )


def paired_row_counts(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.agg(F.count(F.lit(1)).alias("source_count")).withColumn(
        "target_count", scalar(target, F.count(F.lit(1)))
    )


def group_totals(df: DataFrame, key: str, part: str, stated: str, tolerance) -> DataFrame:
    """Keys whose parts do not add up to the stated total."""
    return (
        df.groupBy(F.col(key), F.col(stated).alias("stated_total"))
        .agg(F.sum(part).alias("computed_total"))
        .where(F.abs(F.col("computed_total") - F.col("stated_total")) > tolerance)
        .select(key, "computed_total", "stated_total")
    )


def audit_gaps(df: DataFrame, created: str, updated: str) -> DataFrame:
    return df.where(p.audit_columns_broken(F.col(created), F.col(updated)))


def operation_violations(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    return domain_violations(df, column, allowed)


def volume_history(history: DataFrame, current: DataFrame, spread: float = 3.0) -> DataFrame:
    """Tables whose current row count leaves the band of mean +/- ``spread`` deviations."""
    band = history.groupBy("table_name").agg(
        F.avg("row_count").alias("mean_rows"), F.stddev_samp("row_count").alias("dev_rows"),
        F.count(F.lit(1)).alias("observations"),
    )
    joined = current.join(band, "table_name", "left")
    reach = F.col("dev_rows") * spread
    return joined.select(
        "table_name", "row_count", "mean_rows", "dev_rows", "observations",
        F.when(F.col("dev_rows").isNull(), "NO_HISTORY")
        .when(F.col("row_count") < F.col("mean_rows") - reach, "BELOW_RANGE")
        .when(F.col("row_count") > F.col("mean_rows") + reach, "ABOVE_RANGE")
        .otherwise("IN_RANGE").alias("volume_status"),
    )


def sla_breaches(newest: DataFrame, slas: DataFrame, as_of: Column) -> DataFrame:
    """Newest moment per table (``table_name``, ``newest``) against its allowed staleness."""
    minutes = F.timestamp_diff(
        "MINUTE", F.date_trunc("minute", F.col("newest")), F.date_trunc("minute", as_of)
    )
    limits = slas.where("is_active").select(F.col("target_table").alias("table_name"), "max_staleness_min")
    return newest.join(limits, "table_name").select(
        "table_name", "newest", "max_staleness_min", minutes.alias("staleness_minutes"),
        F.coalesce(minutes > F.col("max_staleness_min"), F.lit(True)).alias("breached"),
    )


def distribution_shift(current: DataFrame, baseline: DataFrame, column: str) -> DataFrame:
    """Share of every value now and before, with the total-variation distance of each."""
    def shares(df: DataFrame, name: str) -> DataFrame:
        total = scalar(df, F.count(F.lit(1)))
        return (
            key_counts(df.select(F.coalesce(F.col(column).cast("string"), F.lit("<NULL>")).alias("value")),
                       ["value"])
            .select("value", (F.col("n") / total).alias(name))
        )

    both = shares(current, "now_share").join(shares(baseline, "base_share"), "value", "full_outer")
    now, base = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("now_share", "base_share"))
    return both.select(
        "value", now.alias("now_share"), base.alias("base_share"),
        F.round(F.abs(now - base) / 2, 6).alias("variation"),
    )


def snapshot_shift(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Total-variation distance per column between two stored distributions, 0 to 1.

    Both are distribution rows (``column_name``, ``value_or_bucket``, ``percentage``) of one table.
    """
    keys = ["column_name", "value_or_bucket"]
    now = current.select(*keys, F.col("percentage").alias("now_pct"))
    base = baseline.select(*keys, F.col("percentage").alias("base_pct"))
    gap = F.abs(F.coalesce("now_pct", F.lit(0.0)) - F.coalesce("base_pct", F.lit(0.0)))
    return now.join(base, keys, "full_outer").groupBy("column_name").agg(
        F.count(F.lit(1)).alias("buckets"), F.round(F.sum(gap) / 200, 6).alias("variation"))


def unreachable(df: DataFrame, node: str, reached: DataFrame) -> DataFrame:
    """Rows whose node the walk from the roots never met; an absent node was never met either."""
    return probe(df, [node], reached.select(node), [node], "left_anti").select(node)
