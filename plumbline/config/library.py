"""The check library: 25 checks with severity, weight and thresholds."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from plumbline.frames import literal_frame
from plumbline.schemas import CHECK_LIBRARY, THRESHOLDS

# Check id, name, category, severity, weight, reviewed-by-model flag.
CHECKS = [
    (1, "Null or Missing Values", "Completeness", "HIGH", "1.50", False),
    (2, "Primary Key Uniqueness", "Integrity", "CRITICAL", "2.00", False),
    (3, "Duplicate Record Detection", "Integrity", "HIGH", "1.50", False),
    (4, "Referential Integrity", "Integrity", "CRITICAL", "2.00", False),
    (5, "Data Type Validation", "Schema", "HIGH", "1.25", False),
    (6, "Numeric Range Validation", "Validity", "MEDIUM", "1.00", False),
    (7, "String Length Validation", "Validity", "LOW", "0.75", False),
    (8, "Regex Pattern Validation", "Validity", "MEDIUM", "1.00", False),
    (9, "Allowed Values / Domain Validation", "Validity", "MEDIUM", "1.00", False),
    (10, "Business Rule Consistency", "Consistency", "HIGH", "1.50", True),
    (11, "Cross-Column Consistency", "Consistency", "MEDIUM", "1.25", True),
    (12, "Timeliness / Freshness", "Timeliness", "CRITICAL", "2.00", False),
    (13, "Completeness", "Completeness", "HIGH", "1.50", False),
    (14, "Volume Check", "Volumetric", "HIGH", "1.25", False),
    (15, "Distribution Check", "Statistical", "MEDIUM", "1.00", True),
    (16, "Outlier Detection", "Statistical", "MEDIUM", "1.00", True),
    (17, "Schema Drift Detection", "Schema", "CRITICAL", "2.00", False),
    (18, "End-to-End Reconciliation", "Reconciliation", "CRITICAL", "2.00", False),
    (19, "Duplicate File Ingestion", "Ingestion", "HIGH", "1.50", False),
    (20, "Negative Value Check", "Validity", "MEDIUM", "1.00", False),
    (21, "Percentage / Total Consistency", "Consistency", "HIGH", "1.50", False),
    (22, "Hierarchy Validation", "Integrity", "HIGH", "1.50", False),
    (23, "Multi-Source Consistency", "Reconciliation", "HIGH", "1.50", True),
    (24, "Audit Column Validation", "Governance", "MEDIUM", "1.00", False),
    (25, "CDC Consistency", "Governance", "HIGH", "1.50", False),
]

DESCRIPTIONS = {
    1: "Values that are absent from a column that must be filled.",
    2: "Key values that occur more than once, an absent key counting as one value.",
    3: "Rows that agree on every one of the listed columns.",
    4: "Foreign keys that name no row of the parent table.",
    5: "Text that cannot be read as the expected type.",
    6: "Numbers outside an inclusive range.",
    7: "Text shorter or longer than allowed.",
    8: "Text that does not match a pattern as a whole.",
    9: "Values outside a closed list.",
    10: "Rows for which a rule names a violation.",
    11: "Rows whose columns contradict one another.",
    12: "Rows not refreshed for more than the allowed number of days.",
    13: "Rows in which all of the required columns are empty.",
    14: "Dated periods that report no volume at all.",
    15: "Values that take more than the allowed share of the table.",
    16: "Numbers further from the mean than the allowed number of deviations.",
    17: "Columns that differ from the recorded schema.",
    18: "Periods whose row count or amount differs between source and target.",
    19: "Files that were loaded more than once.",
    20: "Numbers below zero.",
    21: "Totals that do not equal quantity times price.",
    22: "Tree rows with an unknown parent or that point at each other.",
    23: "Dates for which one source reports several different amounts.",
    24: "Rows whose audit columns are absent or out of order.",
    25: "Change rows with an unknown operation or a repeated sequence number.",
}

# Check id, threshold name, warning limit, fail limit (compared with the failure count).
THRESHOLD_VALUES = [
    (1, "null_pct", "5", "10"),
    (2, "duplicate_count", "0", "0.0001"),
    (3, "duplicate_count", "0", "0.0001"),
    (4, "orphan_count", "0", "0.0001"),
    (5, "type_fail_pct", "1", "5"),
    (6, "range_fail_pct", "1", "5"),
    (7, "length_fail_pct", "2", "5"),
    (8, "regex_fail_pct", "1", "5"),
    (9, "domain_fail_pct", "1", "5"),
    (10, "rule_fail_count", "0", "1"),
    (11, "consistency_fail_pct", "1", "5"),
    (12, "staleness_fail_count", "0", "1"),
    (13, "incomplete_count", "0", "1"),
    (14, "zero_volume_count", "0", "1"),
    (15, "skew_fail_count", "0", "1"),
    (16, "outlier_count", "1", "3"),
    (17, "drift_column_count", "0", "1"),
    (18, "recon_mismatch_count", "0", "1"),
    (19, "dup_file_count", "0", "1"),
    (20, "negative_count", "0", "1"),
    (21, "total_mismatch_count", "0", "1"),
    (22, "hierarchy_fail_count", "0", "1"),
    (23, "multi_source_conflict", "0", "1"),
    (24, "audit_fail_pct", "1", "5"),
    (25, "cdc_fail_count", "0", "1"),
]


def library_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (cid, name, category, DESCRIPTIONS[cid], severity, Decimal(weight), flag, True)
        for cid, name, category, severity, weight, flag in CHECKS
    ]
    return literal_frame(spark, rows, CHECK_LIBRARY)


def threshold_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (number, cid, name, Decimal(warn), Decimal(fail), True)
        for number, (cid, name, warn, fail) in enumerate(THRESHOLD_VALUES, start=1)
    ]
    return literal_frame(spark, rows, THRESHOLDS)
