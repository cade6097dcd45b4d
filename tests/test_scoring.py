"""Predicates and scoring functions: NULLs, limits, rounding."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import predicates as p
from plumbline.functions import scoring


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def dec(value):
    return F.lit(None if value is None else Decimal(value)).cast("decimal(10,4)")


@pytest.mark.parametrize("count,warn,fail,status", [
    (0, "5", "10", "PASS"), (0, None, None, "PASS"), (0, "0", "0", "PASS"),
    (1, "5", "10", "FAIL"), (4, "5", "10", "FAIL"), (5, "5", "10", "WARNING"), (9, "5", "10", "WARNING"),
    (10, "5", "10", "FAIL"), (1, "0", "0.0001", "FAIL"), (1, "1", "5", "WARNING"), (5, "1", "5", "FAIL"),
    (1, None, None, "FAIL"), (3, None, "5", "FAIL"), (3, "1", None, "WARNING"), (7, None, "5", "FAIL"),
])
def test_status(spark, count, warn, fail, status):
    assert one(spark, scoring.check_status(F.lit(count), dec(warn), dec(fail))) == status


@pytest.mark.parametrize("failures,total,fraction", [
    (0, 0, "0.0000"), (5, 0, "0.0000"), (1, 3, "0.3333"), (2, 3, "0.6667"), (1, 20000, "0.0001"),
    (1, 20001, "0.0000"), (7, 7, "1.0000"), (9, 3, "3.0000"),
])
def test_failure_fraction(spark, failures, total, fraction):
    assert one(spark, scoring.failure_fraction(F.lit(failures), F.lit(total))) == Decimal(fraction)


@pytest.mark.parametrize("passed,failed,severity,weight,score", [
    (0, 0, "HIGH", "1.50", "100.00"), (10, 0, "CRITICAL", "2.00", "100.00"), (1, 2, "LOW", "0.75", "23.75"),
    (1, 1, "HIGH", "1.00", "35.00"), (3, 1, "MEDIUM", "1.00", "63.75"), (1, 0, "OTHER", "1.00", "80.00"),
])
def test_score_check(spark, passed, failed, severity, weight, score):
    value = scoring.score_check(F.lit(passed), F.lit(failed), F.lit(severity), F.lit(Decimal(weight)))
    assert one(spark, value) == Decimal(score)


@pytest.mark.parametrize("value,mean,dev,far", [
    (10.0, 0.0, 2.0, True), (-10.0, 0.0, 2.0, True), (6.0, 0.0, 2.0, False), (None, 0.0, 2.0, False),
    (10.0, None, 2.0, False), (10.0, 0.0, None, False), (10.0, 0.0, 0.0, False),
])
def test_is_outlier(spark, value, mean, dev, far):
    cast = [F.lit(v).cast("double") for v in (value, mean, dev)]
    assert one(spark, scoring.is_outlier(*cast, 3)) is far


@pytest.mark.parametrize("value,pattern,match", [
    ("abc", "[a-c]+", True), ("abcd", "[a-c]+", False), (None, "a", False), ("a", None, False), ("a\n", "a", False),
    ("ab", "a|ab", True),
])
def test_matches_pattern(spark, value, pattern, match):
    assert one(spark, scoring.matches_pattern(F.lit(value).cast("string"), pattern)) is match


def test_predicates_let_nulls_pass(spark):
    nothing = F.lit(None)
    number, text = nothing.cast("double"), nothing.cast("string")
    moment = nothing.cast("timestamp_ntz")
    for predicate in [
        p.is_out_of_range(number, 0, 1), p.has_bad_length(text, 1, 2), p.breaks_pattern(text, "a"),
        p.is_outside_domain(text, ["a"]), p.is_negative(number), p.has_wrong_type(text, "NUMBER"),
        p.is_zero_volume(number, moment), p.is_stale(moment, F.lit(dt.datetime(2024, 1, 1)), 1),
        p.total_differs(number, F.lit(1), F.lit(1), 0),
    ]:
        assert not one(spark, predicate)
    assert one(spark, p.is_missing(text)) and one(spark, p.is_blank(F.lit("  ")))


@pytest.mark.parametrize("value,wrong", [("12.5", False), ("ABCXYZ", True), ("", True), (" 7 ", False), ("1e3", False)])
def test_wrong_type(spark, value, wrong):
    assert one(spark, p.has_wrong_type(F.lit(value), "NUMBER")) is wrong


def test_staleness_counts_midnights(spark):
    late, early = dt.datetime(2024, 1, 1, 23, 59), dt.datetime(2024, 1, 2, 0, 1)
    assert one(spark, p.is_stale(F.lit(late), p.as_of_column(early), 0)) is True
    assert one(spark, p.is_stale(F.lit(late), p.as_of_column(early), 1)) is False


def test_clock_is_bound():
    as_of = dt.datetime(2024, 5, 6, 7, 8, 9)
    assert p.bind_clock("d > CURRENT_DATE() AND t < current_timestamp", as_of) == (
        "d > DATE'2024-05-06' AND t < TIMESTAMP_NTZ'2024-05-06 07:08:09.000000'")
    assert p.bind_clock("current_dates > 1", as_of) == "current_dates > 1"


def test_bands(spark):
    scores = {95: ("HEALTHY", "green"), 85: ("WARNING", "green"), 70: ("WARNING", "yellow"),
              50: ("AT_RISK", "yellow"), 49: ("CRITICAL", "red"), None: ("CRITICAL", "red")}
    for score, (band, light) in scores.items():
        value = F.lit(score).cast("double")
        assert (one(spark, scoring.health_band(value)), one(spark, scoring.traffic_light(value))) == (band, light)
