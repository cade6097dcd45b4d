"""Frames derived from the given tables, and the same derivations in SQL.

The tables hold no NULLs, orphans or result records. Defects are put in by one expression that
both sides share; result tables are read off the sales tables, so that they grow with them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import Tables


def both(expression: str) -> Column:
    """An expression that reads the same in both dialects."""
    return F.expr(expression)


# Lines with defects: an absent flag, a blank flag, an unknown flag.
FLAG = (
    "CASE WHEN l_partkey % 97 = 0 THEN NULL WHEN l_partkey % 89 = 0 THEN '  ' "
    "WHEN l_partkey % 83 = 0 THEN 'Z' ELSE l_returnflag END"
)
# Orders whose customer does not exist.
CUSTKEY = "CASE WHEN o_orderkey % 50 = 7 THEN o_custkey + 100000000 ELSE o_custkey END"
# Event values as text, some of them no numbers.
KTEXT_SPARK = "CASE WHEN user_id % 40 = 3 THEN 'n/a' ELSE get_json_object(props, '$.k') END"
KTEXT_SQL = "CASE WHEN user_id % 40 = 3 THEN 'n/a' ELSE json_extract_string(props, '$.k') END"
# Orders as a second source reports them: some prices differ, some orders are missing, some are new.
PERTURBED = (
    "SELECT CASE WHEN o_orderkey % 71 = 5 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, "
    "o_custkey, o_orderstatus, "
    "CASE WHEN o_orderkey % 67 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, o_orderpriority FROM orders"
)
# A tree over parts with unknown parents, self references and mutual references.
PARENT = (
    "CASE WHEN p_partkey = 0 THEN NULL WHEN p_partkey % 97 = 5 THEN p_partkey + 100000000 "
    "WHEN p_partkey % 101 = 7 THEN p_partkey WHEN p_partkey % 103 = 8 THEN p_partkey + 1 "
    "WHEN p_partkey % 103 = 9 THEN p_partkey - 1 ELSE CAST(FLOOR(p_partkey / 3) AS BIGINT) END"
)
# Events as a change log.
OPERATION = (
    "CASE event_type WHEN 'signup' THEN 'I' WHEN 'purchase' THEN 'U' WHEN 'click' THEN 'U' "
    "WHEN 'view' THEN 'D' ELSE 'X' END"
)
SEQUENCE = (
    "CASE WHEN event_id % 61 = 0 THEN event_id - 400 WHEN event_id % 59 = 0 THEN 7 ELSE event_id END"
)


def flagged_lines(t: Tables) -> DataFrame:
    return t["lineitem"].withColumn("flag", both(FLAG))


FLAGGED = f"flagged AS (SELECT *, {FLAG} AS flag FROM lineitem)"


def perturbed_orders(t: Tables) -> DataFrame:
    return t["orders"].selectExpr(
        *[p.strip() for p in _split(PERTURBED[len("SELECT "):-len(" FROM orders")])]
    )


def _split(select_list: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(select_list):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(select_list[start:i])
            start = i + 1
    return [*parts, select_list[start:]]


def part_tree(t: Tables) -> DataFrame:
    return t["part"].select("p_partkey", both(PARENT).cast("bigint").alias("parent"))


TREE = f"tree AS (SELECT p_partkey, {PARENT} AS parent FROM part)"


def change_log(t: Tables) -> DataFrame:
    return t["events"].select(
        "event_id", "ts", "user_id", both(OPERATION).alias("op"), both(SEQUENCE).alias("seq")
    )


CHANGE_LOG = f"change_log AS (SELECT event_id, ts, user_id, {OPERATION} AS op, {SEQUENCE} AS seq FROM events)"

# Check results: one per order line; the order is the run.
STATUS = (
    "CASE WHEN l_tax > 0.075 THEN 'ERROR' WHEN l_returnflag = 'A' THEN 'PASS' "
    "WHEN l_returnflag = 'N' THEN 'WARNING' ELSE 'FAIL' END"
)
SEVERITY = "CASE l_linenumber WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' ELSE 'LOW' END"
RESULT_COLUMNS = {
    "result_id": "concat('R', l_orderkey, '-', l_linenumber, '-', l_partkey)",
    "run_id": "concat('R', l_orderkey)",
    "check_id": "CAST(l_linenumber AS BIGINT)",
    "check_name": "concat('check ', l_linenumber)",
    "target_column": "l_linestatus",
    "check_status": STATUS,
    "total_rows": "l_partkey + l_suppkey",
    "failure_count": "l_suppkey",
    "failure_pct": "l_discount",
    "threshold_warning": "l_linenumber",
    "threshold_fail": "l_linenumber + 5",
    "severity": SEVERITY,
    "weight": "CAST(l_quantity AS DECIMAL(5,2))",
    "execution_time_ms": "l_partkey",
    "error_message": "CASE WHEN l_tax > 0.075 THEN 'no such column' END",
    "created_at": "l_shipdate",
}
RUN_COLUMNS = {
    "run_id": "concat('R', o_orderkey)",
    "run_start_time": "o_orderdate",
    "target_database": "'DW'",
    "target_schema": "o_orderpriority",
    "target_table": "concat('T', o_custkey)",
    "overall_status": "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END",
}
FAILED_RECORD_COLUMNS = {
    "run_id": "concat('R', l_orderkey)",
    "check_id": "CAST(l_linenumber AS BIGINT)",
    "record_identifier": "CAST(l_partkey AS STRING)",
    "column_name": "l_linestatus",
    "failed_value": "CAST(l_suppkey AS STRING)",
    "failure_reason": "concat('check ', l_linenumber)",
    "created_at": "l_shipdate",
}
LIBRARY_COLUMNS = {
    "check_id": "p_partkey",
    "check_name": "p_name",
    "category": "p_brand",
    "description": "p_type",
    "severity": "CASE WHEN p_size > 30 THEN 'HIGH' ELSE 'LOW' END",
    "weight": "p_retailprice",
    "is_ai_check": "p_size > 25",
    "is_active": "p_size <> 1",
}
ASSIGNMENT_COLUMNS = {
    "assignment_id": "l_orderkey * 10 + l_linenumber",
    "check_id": "l_partkey",
    "target_database": "concat('DB', l_linenumber)",
    "target_schema": "l_returnflag",
    "target_table": "concat('T', l_suppkey)",
    "target_column": "l_linestatus",
    "is_active": "l_tax > 0.005",
}
THRESHOLD_COLUMNS = {
    "threshold_id": "p_partkey",
    "check_id": "p_partkey",
    "threshold_name": "p_brand",
    "warning_value": "p_size",
    "fail_value": "p_retailprice",
    "is_active": "p_size > 5",
}


def _select(mapping: dict[str, str]) -> list[str]:
    return [f"{expression} AS {name}" for name, expression in mapping.items()]


def _cte(name: str, mapping: dict[str, str], source: str) -> str:
    columns = ", ".join(_select(mapping)).replace("AS STRING", "AS VARCHAR")
    return f"{name} AS (SELECT {columns} FROM {source})"


def results(t: Tables) -> DataFrame:
    return t["lineitem"].selectExpr(*_select(RESULT_COLUMNS)).withColumn("target_table", F.lit(None).cast("string"))


RESULTS = _cte("results", RESULT_COLUMNS, "lineitem")


def run_rows(t: Tables) -> DataFrame:
    """Runs without the counts of their checks."""
    return t["orders"].selectExpr(*_select(RUN_COLUMNS))


def run_log(t: Tables) -> DataFrame:
    counts = results(t).groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("check_status") == "PASS").alias("passed_checks"),
        F.count_if(F.col("check_status").isin("FAIL", "WARNING")).alias("failed_checks"),
    )
    return run_rows(t).join(counts, "run_id", "left").na.fill(
        0, ["total_checks", "passed_checks", "failed_checks"])


RUNS = RESULTS + ", " + _cte("run_rows", RUN_COLUMNS, "orders") + """,
run_counts AS (SELECT run_id, COUNT(*) AS total_checks, COUNT(*) FILTER (check_status = 'PASS') AS passed_checks,
  COUNT(*) FILTER (check_status IN ('FAIL','WARNING')) AS failed_checks FROM results GROUP BY run_id),
run_log AS (SELECT r.*, COALESCE(total_checks, 0) AS total_checks, COALESCE(passed_checks, 0) AS passed_checks,
  COALESCE(failed_checks, 0) AS failed_checks FROM run_rows r LEFT JOIN run_counts c USING (run_id))"""


def failed_records(t: Tables) -> DataFrame:
    return t["lineitem"].where("l_returnflag = 'R'").selectExpr(*_select(FAILED_RECORD_COLUMNS))


FAILED_RECORDS = _cte("failed_records", FAILED_RECORD_COLUMNS, "lineitem WHERE l_returnflag = 'R'")

# Weights are whole numbers, so that the score is a quotient of whole numbers, rounded half up.
SCORES = RUNS + """,
scores AS (
  SELECT run_id, target_table, total_checks, passed_checks, failed_checks,
    critical_failures, high_failures, medium_failures, low_failures,
    CAST((earned * 20000 + 2 * total) // (4 * total) AS DOUBLE) / 100 AS health_score
  FROM (
    SELECT r.run_id, r.target_table, COUNT(*) AS total_checks,
      COUNT(*) FILTER (check_status = 'PASS') AS passed_checks,
      COUNT(*) FILTER (check_status IN ('FAIL','WARNING')) AS failed_checks,
      COUNT(*) FILTER (severity = 'CRITICAL' AND check_status <> 'PASS') AS critical_failures,
      COUNT(*) FILTER (severity = 'HIGH' AND check_status <> 'PASS') AS high_failures,
      COUNT(*) FILTER (severity = 'MEDIUM' AND check_status <> 'PASS') AS medium_failures,
      COUNT(*) FILTER (severity = 'LOW' AND check_status <> 'PASS') AS low_failures,
      CAST(SUM(CASE check_status WHEN 'PASS' THEN 2 * weight WHEN 'WARNING' THEN weight ELSE 0 END) AS BIGINT) AS earned,
      CAST(SUM(weight) AS BIGINT) AS total
    FROM results c JOIN run_log r USING (run_id) WHERE check_status <> 'ERROR'
    GROUP BY r.run_id, r.target_table) s)"""


def scores(t: Tables) -> DataFrame:
    """Scored by run first; the table of a run is looked up for the scores, not for every result."""
    from plumbline.plans.health import health_scores

    runs = run_rows(t).select("run_id", "target_table")
    return health_scores(results(t)).drop("target_table").join(runs, "run_id")


# Model replies: conversation turns inside a reply of one of eight kinds.
REPLY_KINDS = [
    ("concat('Answer: SAFE_TO_AUTOMATE', chr(10), '```sql', chr(10), 'UPDATE notes SET body = ''', "
     "replace(text, '''', ''''''), ''';', chr(10), '```', chr(10), 'done')"),
    "concat('requires_human_review because ', text)",
    "concat('UNSAFE_TO_AUTOMATE', chr(10), '```sql', chr(10), 'MERGE INTO notes USING t ON TRUE', chr(10), '```', text)",
    ("concat('safe_to_automate: yes', chr(10), '  update notes', chr(10), '   set body = ''', "
     "replace(text, chr(10), ' '), '''', chr(10), chr(10), 'end')"),
    "concat('SAFE_TO_AUTOMATE ', text, chr(10), '```sql', chr(10), 'INSERT INTO x SELECT 1; DROP TABLE notes', chr(10), '```')",
    ("concat('SAFE_TO_AUTOMATE', chr(10), '```sql', chr(10), 'SELECT run_id FROM dq.v_check_summary s JOIN ', "
     "role, '.dq_run_log r ON s.run_id = r.run_id WHERE note = ''a;b'';', chr(10), '```')"),
    "concat('SAFE TO_AUTOMATE', chr(10), text)",
    ("concat('unsafe: ', text, chr(10), 'select * from Orders', chr(10), 'where body = ''', "
     "replace(replace(text, chr(10), ' '), '''', ' '), '''', chr(10), '```')"),
]
REPLY = "CASE (conv_id + turn) % 8 " + " ".join(
    f"WHEN {i} THEN {kind}" for i, kind in enumerate(REPLY_KINDS)
) + " END"
ANALYSIS_TYPE = (
    "CASE role WHEN 'user' THEN 'FAILURE_EXPLANATION' WHEN 'assistant' THEN 'REMEDIATION_RECOMMENDATION' "
    "ELSE 'PROFILE' END"
)
MOMENT_SPARK = "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST({m} AS INT), 0)"
MOMENT_SQL = "TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST({m} AS BIGINT))"
CACHE_COLUMNS = {
    "analysis_id": "concat('A', conv_id, '-', turn)",
    "analysis_type": ANALYSIS_TYPE,
    "run_id": "concat('R', conv_id)",
    "check_id": "turn",
    "target_table": "concat('T', conv_id)",
    "ai_response": REPLY,
    "model_used": "concat('model-', role)",
    "status": "'COMPLETED'",
    "created_at": "conv_id * 10 + turn",
}
APPROVAL_COLUMNS = {
    "approval_id": "concat('Q', doc_id)",
    "recommendation_id": "concat('A', doc_id, '-', 1 + 2 * quality)",
    "target_table": "concat('T', doc_id)",
    "approval_status": "CASE WHEN quality = 0 THEN 'REJECTED' WHEN toxic = 1 THEN 'PENDING' ELSE 'APPROVED' END",
    "requested_at": "doc_id",
    "reviewer": "concat('reviewer ', toxic)",
    "review_comments": "concat('quality ', quality)",
}
AUDIT_COLUMNS = {
    "audit_id": "concat('D', doc_id)",
    "analysis_id": "concat('A', doc_id, '-', CASE lang WHEN 'en' THEN 3 ELSE 5 END)",
    "target_table": "concat('T', doc_id)",
    "action_sql": "concat('UPDATE ', source, ' SET x = 1')",
    "status": "CASE lang WHEN 'en' THEN 'SUCCESS' WHEN 'fr' THEN 'FAILED' ELSE 'STARTED' END",
    "error_message": "CASE lang WHEN 'fr' THEN source END",
    "executed_by": "source",
    "executed_at": "doc_id",
}


def _timed(mapping: dict[str, str], moment: str, template: str) -> dict[str, str]:
    return {**mapping, moment: template.format(m=f"({mapping[moment]})")}


def analysis_cache(t: Tables) -> DataFrame:
    return cache_of(t["conversations"])


def cache_of(conversations: DataFrame) -> DataFrame:
    return conversations.selectExpr(*_select(_timed(CACHE_COLUMNS, "created_at", MOMENT_SPARK)))


CACHE = _cte("cache", _timed(CACHE_COLUMNS, "created_at", MOMENT_SQL), "conversations")


def approvals(t: Tables) -> DataFrame:
    return t["labels"].selectExpr(*_select(_timed(APPROVAL_COLUMNS, "requested_at", MOMENT_SPARK)))


APPROVALS = _cte("approvals", _timed(APPROVAL_COLUMNS, "requested_at", MOMENT_SQL), "labels")


def audit(t: Tables) -> DataFrame:
    return audit_of(t["documents"])


def audit_of(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(*_select(_timed(AUDIT_COLUMNS, "executed_at", MOMENT_SPARK)))


AUDIT = _cte("audit", _timed(AUDIT_COLUMNS, "executed_at", MOMENT_SQL), "documents")


def library(t: Tables) -> DataFrame:
    return t["part"].selectExpr(*_select(LIBRARY_COLUMNS))


LIBRARY = _cte("library", LIBRARY_COLUMNS, "part")


def assignments(t: Tables) -> DataFrame:
    return t["lineitem"].selectExpr(*_select(ASSIGNMENT_COLUMNS)).withColumn(
        "params", F.create_map(F.lit("record_id"), F.col("target_column")))


ASSIGNMENTS = _cte("assignments", ASSIGNMENT_COLUMNS, "lineitem")


def thresholds(t: Tables) -> DataFrame:
    return t["part"].selectExpr(*_select(THRESHOLD_COLUMNS))


THRESHOLDS = _cte("thresholds", THRESHOLD_COLUMNS, "part")


# Schemas at scale: orders are tables, their line numbers are column positions. Open lines are the
# schema now, shipped lines the past; a line keeps its position and may change name or type.
COLUMN_PARTS = {
    "table_schema": "'DW'",
    "table_name": "concat('T', l_orderkey)",
    "column_name": "concat('C', l_linenumber, chr(flag))",
    "data_type": "CASE WHEN quantity > 40 THEN 'decimal' ELSE 'long' END",
    "ordinal_position": "CAST(l_linenumber AS BIGINT)",
}


def current_columns(t: Tables) -> DataFrame:
    return columns_of(t["lineitem"])


def columns_of(lines: DataFrame) -> DataFrame:
    return (
        lines.where("l_linestatus = 'O'").groupBy("l_orderkey", "l_linenumber")
        .agg(F.max(F.ascii("l_returnflag")).alias("flag"), F.max("l_quantity").alias("quantity"))
        .selectExpr(*_select(COLUMN_PARTS))
    )


_LINES = "SELECT l_orderkey, l_linenumber, MAX(ascii(l_returnflag)) AS flag, MAX(l_quantity) AS quantity"
COLUMNS_NOW = _cte(
    "columns_now", COLUMN_PARTS,
    f"({_LINES} FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_linenumber)")


def schema_snapshots(t: Tables) -> DataFrame:
    return snapshots_of(t["lineitem"])


def snapshots_of(lines: DataFrame) -> DataFrame:
    year = F.date_trunc("year", "l_shipdate").cast("timestamp_ntz")
    return (
        lines.where("l_linestatus = 'F'").groupBy("l_orderkey", "l_linenumber", year.alias("snapshot_at"))
        .agg(F.max(F.ascii("l_returnflag")).alias("flag"), F.max("l_quantity").alias("quantity"))
        .selectExpr(*_select(COLUMN_PARTS), "snapshot_at")
    )


SNAPSHOTS = _cte(
    "snapshots", {**COLUMN_PARTS, "snapshot_at": "CAST(moment AS TIMESTAMP)"},
    f"({_LINES}, date_trunc('year', l_shipdate) AS moment FROM lineitem WHERE l_linestatus = 'F' "
    "GROUP BY l_orderkey, l_linenumber, moment)")


# Daily event counts as a history of table profiles.
def profile_history(t: Tables) -> DataFrame:
    return (
        t["events"].groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("profiled_at"))
        .agg(F.count(F.lit(1)).alias("row_count"))
        .selectExpr("concat(event_type, '-', CAST(profiled_at AS DATE)) AS profile_id", "'DW' AS database_name",
                    "'web' AS schema_name", "event_type AS table_name", "row_count",
                    "CAST(6 AS BIGINT) AS column_count", "profiled_at", "'COMPLETED' AS profile_status")
    )


PROFILE_HISTORY = """history AS (SELECT 'DW' AS database_name, 'web' AS schema_name, event_type AS table_name,
  COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count, CAST(date_trunc('day', ts) AS TIMESTAMP) AS profiled_at,
  'COMPLETED' AS profile_status FROM events GROUP BY event_type, date_trunc('day', ts))"""

AS_OF = dt.datetime(2024, 1, 31)
