"""Column layouts of configuration, result, profile and remediation frames."""

from __future__ import annotations

from pyspark.sql import types as T


_NESTED = {
    "params": T.MapType(T.StringType(), T.StringType()),
    "top_values": T.ArrayType(T.StructType([
        T.StructField("value", T.StringType()), T.StructField("count", T.LongType()),
    ])),
}


def columns(text: str) -> T.StructType:
    """``name type`` pairs separated by ``", "``; needs no running session."""
    schema = T.StructType()
    for pair in text.split(", "):
        name, kind = pair.split(" ", 1)
        schema.add(name, _NESTED.get(name) or kind.replace("bigint", "long"))
    return schema


CHECK_LIBRARY = columns(
    "check_id bigint, check_name string, category string, description string, "
    "severity string, weight decimal(5,2), is_ai_check boolean, is_active boolean"
)
ASSIGNMENTS = columns(
    "assignment_id bigint, check_id bigint, target_database string, target_schema string, "
    "target_table string, target_column string, params map, is_active boolean"
)
THRESHOLDS = columns(
    "threshold_id bigint, check_id bigint, threshold_name string, warning_value decimal(10,4), "
    "fail_value decimal(10,4), is_active boolean"
)
FRESHNESS_SLAS = columns(
    "sla_id bigint, target_database string, target_schema string, target_table string, "
    "max_staleness_min bigint, expected_load_time string, is_active boolean"
)
RUN_LOG = columns(
    "run_id string, run_start_time timestamp_ntz, run_end_time timestamp_ntz, "
    "target_database string, target_schema string, target_table string, total_checks bigint, "
    "passed_checks bigint, failed_checks bigint, overall_status string, triggered_by string, "
    "created_at timestamp_ntz"
)
CHECK_RESULTS = columns(
    "result_id string, run_id string, check_id bigint, check_name string, target_table string, "
    "target_column string, check_status string, total_rows bigint, failure_count bigint, "
    "failure_pct decimal(18,4), threshold_warning decimal(10,4), threshold_fail decimal(10,4), "
    "severity string, weight decimal(5,2), score decimal(5,2), execution_time_ms bigint, "
    "error_message string, created_at timestamp_ntz"
)
FAILED_RECORDS = columns(
    "failure_id string, run_id string, check_id bigint, target_table string, "
    "record_identifier string, column_name string, failed_value string, failure_reason string, "
    "created_at timestamp_ntz"
)
HEALTH_SCORES = columns(
    "score_id string, run_id string, target_table string, health_score decimal(5,2), "
    "total_checks bigint, passed_checks bigint, failed_checks bigint, critical_failures bigint, "
    "high_failures bigint, medium_failures bigint, low_failures bigint, "
    "score_calculated_at timestamp_ntz"
)
TABLE_PROFILES = columns(
    "profile_id string, database_name string, schema_name string, table_name string, "
    "row_count bigint, column_count bigint, profiled_at timestamp_ntz, profile_status string"
)
COLUMN_PROFILES = columns(
    "database_name string, schema_name string, table_name string, column_name string, "
    "data_type string, row_count bigint, null_count bigint, null_pct double, "
    "distinct_count bigint, min_value string, max_value string, typed_min string, typed_max string, "
    "mean double, median double, typed_median string, "
    "top_values array, pattern_summary string, "
    "profiled_at timestamp_ntz"
)
PROFILE_STATES = columns(
    "database_name string, schema_name string, table_name string, part string, column_name string, data_type string, "
    "row_count bigint, null_count bigint, min_value string, max_value string, typed_min string, typed_max string, "
    "total double, distinct_sketch binary, rank_sketch binary, profiled_at timestamp_ntz"
)
DISTRIBUTION_SNAPSHOTS = columns(
    "database_name string, schema_name string, table_name string, column_name string, "
    "value_or_bucket string, record_count bigint, percentage double, snapshot_at timestamp_ntz"
)
SCHEMA_SNAPSHOTS = columns(
    "snapshot_id bigint, table_catalog string, table_schema string, table_name string, "
    "column_name string, ordinal_position bigint, data_type string, "
    "character_maximum_length bigint, numeric_precision bigint, numeric_scale bigint, "
    "is_nullable string, snapshot_at timestamp_ntz"
)
ANALYSIS_CACHE = columns(
    "analysis_id string, analysis_type string, run_id string, check_id bigint, "
    "target_table string, target_column string, input_context string, ai_response string, "
    "model_used string, token_count bigint, status string, created_at timestamp_ntz"
)
RECOMMENDATIONS = columns(
    "recommendation_id string, analysis_id string, run_id string, check_id bigint, "
    "target_table string, recommendation_type string, recommendation_text string, "
    "proposed_sql string, safety_classification string, status string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz"
)
REMEDIATION_AUDIT = columns(
    "audit_id string, analysis_id string, target_table string, action_sql string, status string, "
    "error_message string, executed_by string, executed_at timestamp_ntz"
)
APPROVAL_QUEUE = columns(
    "approval_id string, recommendation_id string, target_table string, approval_status string, "
    "requested_at timestamp_ntz, reviewed_at timestamp_ntz, reviewer string, "
    "review_comments string"
)
