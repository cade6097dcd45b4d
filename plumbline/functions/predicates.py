"""Row predicates: TRUE marks a failing row, NULL and FALSE both pass."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Type names accepted in check parameters, and the Spark type each one tests.
TYPE_ALIASES = {
    "NUMBER": "decimal(38,0)",
    "INTEGER": "decimal(38,0)",
    "INT": "decimal(38,0)",
    "FLOAT": "double",
    "DECIMAL": "decimal(38,0)",
    "NUMERIC": "decimal(38,0)",
    "BIGINT": "decimal(38,0)",
    "SMALLINT": "decimal(38,0)",
    "TINYINT": "decimal(38,0)",
    "BYTEINT": "decimal(38,0)",
    "DOUBLE": "double",
    "DOUBLE PRECISION": "double",
    "REAL": "double",
    "FLOAT4": "double",
    "FLOAT8": "double",
    "VARCHAR": "string",
    "CHAR": "string",
    "CHARACTER": "string",
    "STRING": "string",
    "TEXT": "string",
    "DATETIME": "timestamp_ntz",
    "TIMESTAMP": "timestamp_ntz",
    "TIMESTAMP_NTZ": "timestamp_ntz",
    "TIMESTAMP_LTZ": "timestamp",
    "TIMESTAMP_TZ": "timestamp",
}
EXACT_NUMBERS = ("NUMBER", "DECIMAL", "NUMERIC")


def spark_type(name: str) -> str:
    """The Spark type for a type name, with or without precision or length; unknown names are taken as Spark's."""
    parts = re.fullmatch(r"\s*([A-Za-z_0-9 ]+?)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\))?\s*", name)
    if not parts:
        return name
    base = parts[1].upper()
    if parts[2] and base in EXACT_NUMBERS:
        return f"decimal({parts[2]},{parts[3] or 0})"
    return TYPE_ALIASES.get(base, name)


def full_match(pattern: str) -> str:
    """A pattern that must cover the whole value; ``rlike`` alone only searches."""
    return rf"\A(?:{pattern})\z"


def is_missing(value: Column) -> Column:
    return value.isNull()


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def has_wrong_type(value: Column, expected_type: str) -> Column:
    return value.isNotNull() & value.try_cast(spark_type(expected_type)).isNull()


def is_out_of_range(value: Column, low, high) -> Column:
    return (value < low) | (value > high)


def has_bad_length(value: Column, shortest: int, longest: int) -> Column:
    return value.isNotNull() & ~F.length(value).between(shortest, longest)


def breaks_pattern(value: Column, pattern: str) -> Column:
    return value.isNotNull() & ~value.rlike(full_match(pattern))


def is_outside_domain(value: Column, allowed: list) -> Column:
    return value.isNotNull() & ~value.isin(allowed)


def is_stale(moment: Column, as_of: Column, max_days: int) -> Column:
    """Counts the midnights between the two moments, not elapsed 24-hour periods."""
    return F.datediff(as_of, moment) > max_days


def is_zero_volume(volume: Column, day: Column) -> Column:
    return (volume == 0) & day.isNotNull()


def is_negative(value: Column) -> Column:
    return value < 0


def total_differs(total: Column, quantity: Column, price: Column, tolerance) -> Column:
    return quantity.isNotNull() & price.isNotNull() & (F.abs(total - quantity * price) > tolerance)


def audit_columns_broken(created: Column, updated: Column) -> Column:
    return created.isNull() | updated.isNull() | (updated < created)


def bind_clock(rule: str, as_of: dt.datetime) -> str:
    """Replace clock functions in a rule by the run's ``as_of`` so that a rerun gives the same answer.

    Text literals, in single or double quotes, and back-quoted names stay as they are.
    """
    clocks = {"current_date": f"DATE'{as_of:%Y-%m-%d}'", "current_timestamp": f"TIMESTAMP_NTZ'{as_of:%Y-%m-%d %H:%M:%S.%f}'"}
    parts = r"""'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*"|`[^`]*`|\b(current_date|current_timestamp)\b(?:\s*\(\s*\))?"""
    return re.sub(parts, lambda m: clocks[m[1].lower()] if m[1] else m[0], rule, flags=re.IGNORECASE)


def as_of_column(as_of: dt.datetime) -> Column:
    return F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
