"""Row checks: each returns the failing rows of a table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import predicates as p


def failing_rows(df: DataFrame, predicate: Column, record_id: str, **extra: Column) -> DataFrame:
    return df.where(predicate).select(
        F.col(record_id).alias("record_id"), *[c.alias(name) for name, c in extra.items()]
    )


def null_values(df: DataFrame, column: str, record_id: str) -> DataFrame:
    return failing_rows(df, p.is_missing(F.col(column)), record_id, column_name=F.lit(column))


def wrong_types(
    df: DataFrame, column: str, record_id: str, expected_type: str, row_filter: str | None = None
) -> DataFrame:
    rows = df.where(row_filter) if row_filter else df
    return failing_rows(
        rows, p.has_wrong_type(F.col(column), expected_type), record_id, failed_value=F.col(column)
    )


def out_of_range(df: DataFrame, column: str, record_id: str, low, high) -> DataFrame:
    return failing_rows(
        df, p.is_out_of_range(F.col(column), low, high), record_id, failed_value=F.col(column)
    )


def bad_lengths(df: DataFrame, column: str, record_id: str, shortest: int, longest: int) -> DataFrame:
    return failing_rows(
        df, p.has_bad_length(F.col(column), shortest, longest), record_id,
        failed_value=F.col(column), actual_len=F.length(column),
    )


def pattern_breaks(df: DataFrame, column: str, record_id: str, pattern: str) -> DataFrame:
    return failing_rows(
        df, p.breaks_pattern(F.col(column), pattern), record_id, failed_value=F.col(column)
    )


def outside_domain(df: DataFrame, column: str, record_id: str, allowed: list) -> DataFrame:
    return failing_rows(
        df, p.is_outside_domain(F.col(column), allowed), record_id, failed_value=F.col(column)
    )


def rule_violations(df: DataFrame, rule: str, record_id: str, as_of: dt.datetime | None = None) -> DataFrame:
    """Rows for which the rule, which names the *violation*, is TRUE."""
    return failing_rows(df, F.expr(p.bind_clock(rule, as_of) if as_of else rule), record_id)


def stale_rows(df: DataFrame, column: str, record_id: str, max_days: int, as_of: dt.datetime) -> DataFrame:
    now = p.as_of_column(as_of)
    return failing_rows(
        df, p.is_stale(F.col(column), now, max_days), record_id,
        failed_value=F.col(column), days_stale=F.datediff(now, F.col(column)),
    )


def zero_volumes(df: DataFrame, volume: str, day: str, record_id: str) -> DataFrame:
    return failing_rows(
        df, p.is_zero_volume(F.col(volume), F.col(day)), record_id, failed_value=F.col(volume)
    )


def negatives(df: DataFrame, column: str, record_id: str) -> DataFrame:
    return failing_rows(df, p.is_negative(F.col(column)), record_id, failed_value=F.col(column))


def total_mismatches(
    df: DataFrame, quantity: str, price: str, total: str, tolerance, record_id: str
) -> DataFrame:
    return failing_rows(
        df, p.total_differs(F.col(total), F.col(quantity), F.col(price), tolerance), record_id,
        failed_value=F.col(total), expected_total=F.col(quantity) * F.col(price),
    )


def unknown_operations(df: DataFrame, column: str, record_id: str, allowed: list[str]) -> DataFrame:
    return outside_domain(df, column, record_id, allowed)
