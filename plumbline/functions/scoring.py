"""Scalar scoring functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.predicates import full_match

# Factor applied to a check's pass rate, by severity; others use the default.
SEVERITY_FACTORS = {"CRITICAL": "0.50", "HIGH": "0.70", "MEDIUM": "0.85", "LOW": "0.95"}
DEFAULT_SEVERITY_FACTOR = "0.80"


def _dec(value, precision: str = "decimal(18,4)") -> Column:
    return (value if isinstance(value, Column) else F.lit(value)).cast(precision)


def score_check(passed: Column, failed: Column, severity: Column, weight: Column) -> Column:
    """Pass rate in percent, scaled by severity factor and weight, to two decimals."""
    factor = F.lit(DEFAULT_SEVERITY_FACTOR)
    for name, value in SEVERITY_FACTORS.items():
        factor = F.when(severity == name, F.lit(value)).otherwise(factor)
    attempts = passed + failed
    points = passed.cast("decimal(18,0)") * _dec(factor, "decimal(3,2)") * _dec(weight, "decimal(9,2)") * 100
    scaled = F.round(points / F.nullif(attempts, F.lit(0)).cast("decimal(18,0)"), 2)
    return F.when(attempts == 0, F.lit("100").cast("decimal(18,2)")).otherwise(
        scaled.cast("decimal(18,2)")
    )


def is_outlier(value: Column, mean: Column, stddev: Column, threshold) -> Column:
    """FALSE, never NULL, when any input is unknown or the spread is zero."""
    distance = F.abs(value - mean) / F.nullif(stddev, F.lit(0.0))
    return F.coalesce(distance > threshold, F.lit(False))


def matches_pattern(value: Column, pattern: str | None) -> Column:
    """FALSE on NULL; otherwise TRUE when the whole value matches."""
    if pattern is None:
        return F.lit(False)
    return F.coalesce(value.rlike(full_match(pattern)), F.lit(False))


def failure_fraction(failures: Column, total: Column) -> Column:
    """Failures per row as a 0-1 fraction at four decimals, half rounded up; 0 for an empty table."""
    scaled = F.floor(failures * F.lit(10000.0) / F.nullif(total, F.lit(0)) + 0.5)
    return F.coalesce((scaled.cast("decimal(14,0)") / 10000).cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))


def check_status(count: Column, warning: Column, fail: Column) -> Column:
    """Status from the failure *count*.

    A count under both limits is still a failure: only zero passes, and WARNING needs the
    warning limit reached. Unset limits skip their branch.
    """
    return (
        F.when(count == 0, "PASS")
        .when(F.coalesce(count >= fail, F.lit(False)), "FAIL")
        .when(F.coalesce(count >= warning, F.lit(False)), "WARNING")
        .otherwise("FAIL")
    )


def health_band(score: Column) -> Column:
    return (
        F.when(score >= 90, "HEALTHY")
        .when(score >= 70, "WARNING")
        .when(score >= 50, "AT_RISK")
        .otherwise("CRITICAL")
    )


def traffic_light(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 50, "yellow").otherwise("red")
