"""Replies, reports, repairs, change feeds and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from plumbline.config.specs import spec
from plumbline.functions import text
from plumbline.operators import delta, repair
from plumbline.plans import dashboards, health, profiling, remediation, reports
from plumbline.session import scratch_path
from plumbline.streaming import checks as stream_checks
from plumbline.streaming import feeds, group_checks
from plumbline.workloads import derive as d
from plumbline.workloads.group_level import DRIFT_SUMMARY
from plumbline.workloads.registry import workload
from plumbline.workloads.result_level import stored


SAFETY_LIKE = """CASE WHEN UPPER(ai_response) LIKE '%SAFE_TO_AUTOMATE%' THEN 'SAFE_TO_AUTOMATE'
  WHEN UPPER(ai_response) LIKE '%REQUIRES_HUMAN_REVIEW%' THEN 'REQUIRES_HUMAN_REVIEW'
  WHEN UPPER(ai_response) LIKE '%UNSAFE%' THEN 'UNSAFE' ELSE 'UNKNOWN' END"""
SAFETY = """CASE WHEN contains(UPPER(ai_response), 'SAFE_TO_AUTOMATE') THEN 'SAFE_TO_AUTOMATE'
  WHEN contains(UPPER(ai_response), 'REQUIRES_HUMAN_REVIEW') THEN 'REQUIRES_HUMAN_REVIEW'
  WHEN contains(UPPER(ai_response), 'UNSAFE') THEN 'UNSAFE' ELSE 'UNKNOWN' END"""
WHOLE_WORDS = r"""CASE WHEN regexp_matches(UPPER(ai_response), '(^|[^A-Z_])(NOT|UN|NON)[ _-]*SAFE_TO_AUTOMATE')
    OR contains(UPPER(ai_response), 'REQUIRES_HUMAN_REVIEW') THEN 'REQUIRES_HUMAN_REVIEW'
  WHEN regexp_matches(UPPER(ai_response), '(^|[^A-Z_])SAFE_TO_AUTOMATE($|[^A-Z_])') THEN 'SAFE_TO_AUTOMATE'
  WHEN contains(UPPER(ai_response), 'UNSAFE') THEN 'UNSAFE' ELSE 'UNKNOWN' END"""


def _trim(expression):
    return rf"regexp_replace({expression}, '\A\s+|\s+\z', '', 'g')"


def _extracted(start):
    """Fenced block, else the lines from the first statement to the next empty line or fence."""
    return rf"""split AS (
  SELECT *, {_trim(r"regexp_extract(ai_response, '```sql[^\n]*\n(.*?)```', 1, 's')")} AS fenced,
    [{_trim('x')} FOR x IN string_split(ai_response, chr(10))] AS all_lines FROM cache),
started AS (
  SELECT *, list_position([regexp_matches(UPPER(x), '{start}') FOR x IN all_lines], TRUE) AS first FROM split),
rest AS (
  SELECT *, CASE WHEN first > 0 THEN all_lines[first:] END AS tail,
    list_position([x = '' OR x = '```' FOR x IN all_lines[first:]], TRUE) AS stop FROM started),
found AS (
  SELECT *, CASE WHEN LENGTH(fenced) > 0 THEN fenced WHEN first > 0 THEN
    array_to_string(CASE WHEN stop > 0 THEN tail[1:stop - 1] ELSE tail END, ' ') END AS raw FROM rest),
extracted AS (SELECT *, CASE WHEN LENGTH(raw) >= 10 THEN raw END AS sql_text FROM found)"""


STATEMENTS = d.CACHE + ", " + _extracted(r"\A(UPDATE|INSERT|MERGE) ")
QUERIES = d.CACHE + ", " + _extracted(r"\ASELECT") + r""",
queries AS (SELECT *, regexp_replace(sql_text, ';\s*\z', '') AS query FROM extracted)"""


def _blocked(words, target):
    listed = ", ".join(f"'{w}'" for w in words)
    return f"TRIM([w FOR w IN [{listed}] IF contains(UPPER({target}), w)][1])"


@workload("classify_safety", f"WITH {d.CACHE} SELECT analysis_id, {SAFETY} AS safety FROM cache")
def classify_safety(t):
    """The first word found decides."""
    return d.analysis_cache(t).select(
        "analysis_id", text.classify_safety(F.col("ai_response"), whole_words=False).alias("safety"))


@workload("classify_whole_words", f"WITH {d.CACHE} SELECT analysis_id, {WHOLE_WORDS} AS safety FROM cache")
def classify_whole_words(t):
    return d.analysis_cache(t).select(
        "analysis_id", text.classify_safety(F.col("ai_response")).alias("safety"))


@workload("extract_sql", f"WITH {STATEMENTS} SELECT analysis_id, sql_text FROM extracted")
def extract_sql(t):
    return d.analysis_cache(t).select("analysis_id", text.extract_statement(F.col("ai_response")).alias("sql_text"))


@workload("extract_query", f"WITH {QUERIES} SELECT analysis_id, query FROM queries")
def extract_query(t):
    return d.analysis_cache(t).select("analysis_id", text.extract_query(F.col("ai_response")).alias("query"))


GUARDED = STATEMENTS + f""", guarded AS (SELECT *, {_trim('UPPER(sql_text)')} AS up,
  {_blocked(text.WRITE_BLOCKED, 'sql_text')} AS word FROM extracted),
verdicts AS (SELECT *, CASE WHEN sql_text IS NULL THEN 'ERROR' WHEN word IS NOT NULL THEN 'BLOCKED'
    WHEN NOT (starts_with(up, 'UPDATE ') OR starts_with(up, 'INSERT ') OR starts_with(up, 'MERGE ')) THEN 'BLOCKED'
    ELSE 'ACCEPTED' END AS guard_status,
  CASE WHEN sql_text IS NULL THEN 'no statement found' WHEN word IS NOT NULL THEN 'blocked keyword: ' || word
    WHEN NOT (starts_with(up, 'UPDATE ') OR starts_with(up, 'INSERT ') OR starts_with(up, 'MERGE '))
      THEN 'not UPDATE, INSERT or MERGE' END AS guard_message FROM guarded)"""


@workload("guard_dml", f"WITH {GUARDED} SELECT analysis_id, guard_status, guard_message FROM verdicts")
def guard_dml(t):
    verdict = text.guard_statement(text.extract_statement(F.col("ai_response")))
    return d.analysis_cache(t).select("analysis_id", verdict.alias("v")).select(
        "analysis_id", F.col("v.status").alias("guard_status"), F.col("v.message").alias("guard_message"))


APPROVED = ", ".join(f"'{o}'" for o in text.READABLE_OBJECTS)
FOREIGN = (
    r"[n FOR n IN regexp_extract_all(query, '(?i)(?:FROM|JOIN)\s+([A-Za-z0-9_.]+)', 1) "
    f"IF NOT list_contains([{APPROVED}], string_split(UPPER(n), '.')[-1])]"
)
SECOND = r"""contains(regexp_replace(query, '''[^'']*(''|\z)', '', 'g'), ';')"""


@workload("guard_select", f"""WITH {QUERIES}, judged AS (SELECT *, {_trim('UPPER(query)')} AS up,
  {_blocked(text.READ_BLOCKED, 'query')} AS word, {FOREIGN}[1] AS alien, {SECOND} AS several FROM queries)
SELECT analysis_id, CASE WHEN query IS NULL THEN 'ERROR'
    WHEN NOT (starts_with(up, 'SELECT') OR starts_with(up, 'WITH')) OR word IS NOT NULL OR several OR alien IS NOT NULL
    THEN 'BLOCKED' ELSE 'ACCEPTED' END AS guard_status,
  CASE WHEN query IS NULL THEN 'no query found'
    WHEN NOT (starts_with(up, 'SELECT') OR starts_with(up, 'WITH')) THEN 'not SELECT or WITH'
    WHEN word IS NOT NULL THEN 'blocked keyword: ' || word WHEN several THEN 'several statements'
    WHEN alien IS NOT NULL THEN 'unapproved object: ' || alien END AS guard_message FROM judged""")
def guard_select(t):
    verdict = text.guard_query(text.extract_query(F.col("ai_response")))
    return d.analysis_cache(t).select("analysis_id", verdict.alias("v")).select(
        "analysis_id", F.col("v.status").alias("guard_status"), F.col("v.message").alias("guard_message"))


@workload("allow_list", f"""WITH {QUERIES}
SELECT analysis_id, array_to_string({FOREIGN}, ',') AS foreign_objects FROM queries WHERE query IS NOT NULL""")
def allow_list(t):
    query = text.extract_query(F.col("ai_response"))
    return d.analysis_cache(t).select("analysis_id", query.alias("query")).where("query IS NOT NULL").select(
        "analysis_id", F.array_join(text.unapproved_objects(F.col("query")), ",").alias("foreign_objects"))


def _decisions(safety):
    return f"""WITH {GUARDED}, {d.AUDIT},
applied AS (SELECT DISTINCT analysis_id FROM audit WHERE status = 'SUCCESS'),
safe AS (SELECT *, {safety} AS safety, analysis_id IN (SELECT analysis_id FROM applied) AS applied FROM verdicts),
decided AS (SELECT *, CASE WHEN analysis_type <> 'REMEDIATION_RECOMMENDATION' THEN 'ERROR'
    WHEN safety <> 'SAFE_TO_AUTOMATE' THEN 'SKIPPED' WHEN guard_status <> 'ACCEPTED' THEN guard_status
    WHEN applied THEN 'ALREADY_APPLIED' ELSE 'READY' END AS decision FROM safe)
SELECT analysis_id AS recommendation_id, target_table, safety AS safety_classification, decision AS status,
  CASE WHEN analysis_type <> 'REMEDIATION_RECOMMENDATION' THEN 'not a recommendation: ' || analysis_type
    WHEN safety <> 'SAFE_TO_AUTOMATE' THEN 'needs review: ' || safety
    WHEN guard_status <> 'ACCEPTED' THEN guard_message WHEN applied THEN 'already applied' END AS message,
  CASE WHEN decision = 'READY' THEN sql_text END AS action_sql FROM decided"""


@workload("apply_decisions", _decisions(WHOLE_WORDS))
def apply_decisions(t):
    return remediation.apply_decisions(d.analysis_cache(t), d.audit(t))


@workload("apply_first_word", _decisions(SAFETY))
def apply_first_word(t):
    return remediation.apply_decisions(d.analysis_cache(t), d.audit(t), whole_words=False)


@workload("audit_rows", f"""WITH decided AS ({_decisions(WHOLE_WORDS)})
SELECT recommendation_id AS analysis_id, target_table, action_sql,
  CASE WHEN CAST(split_part(split_part(recommendation_id, 'A', 2), '-', 1) AS BIGINT) % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status
FROM decided WHERE status = 'READY'""")
def audit_rows(t):
    """Every second conversation's statement fails; one audit row per executed decision."""
    decisions = remediation.apply_decisions(d.analysis_cache(t), d.audit(t))
    number = F.split_part(F.split_part("recommendation_id", F.lit("A"), F.lit(2)), F.lit("-"), F.lit(1)).cast("bigint")
    outcomes = decisions.select("recommendation_id", F.when(number % 2 != 0, "refused").alias("error_message"))
    rows = remediation.audit_rows(decisions, outcomes, dt.datetime(2024, 1, 31), "robot")
    return rows.select("analysis_id", "target_table", "action_sql", "status")


JOINED = f"""{d.CACHE}, {d.APPROVALS}, {d.AUDIT},
joined AS (SELECT c.*, {SAFETY_LIKE} AS safety, q.approval_status AS queue_status, q.requested_at, q.reviewer,
  q.review_comments, a.status AS audit_status, a.action_sql, a.error_message, a.executed_at, a.executed_by
  FROM cache c LEFT JOIN approvals q ON c.analysis_id = q.recommendation_id
  LEFT JOIN audit a ON c.analysis_id = a.analysis_id WHERE c.analysis_type = 'REMEDIATION_RECOMMENDATION')"""
PENDING = JOINED + """, pending AS (SELECT analysis_id AS recommendation_id, analysis_id, run_id, check_id, target_table,
  analysis_type AS recommendation_type, ai_response AS recommendation_text, safety AS safety_classification,
  status AS recommendation_status,
  COALESCE(queue_status, CASE WHEN safety = 'SAFE_TO_AUTOMATE' THEN 'AUTO_ELIGIBLE' ELSE 'AWAITING_REVIEW' END) AS approval_status,
  requested_at, created_at, executed_at AS last_executed_at,
  CASE WHEN audit_status = 'SUCCESS' THEN 'APPLIED' WHEN audit_status = 'FAILED' THEN 'EXECUTION_FAILED'
    WHEN queue_status = 'REJECTED' THEN 'REJECTED' WHEN queue_status = 'APPROVED' THEN 'APPROVED_PENDING_EXECUTION'
    WHEN safety = 'SAFE_TO_AUTOMATE' THEN 'SAFE_READY' WHEN safety = 'REQUIRES_HUMAN_REVIEW' THEN 'AWAITING_HUMAN_REVIEW'
    ELSE 'PENDING' END AS action_status FROM joined)"""
HISTORY = JOINED + """, history AS (SELECT analysis_id AS recommendation_id, analysis_id, run_id, check_id, target_table,
  safety AS safety_classification, status AS recommendation_status, COALESCE(queue_status, 'N/A') AS approval_status,
  COALESCE(audit_status, 'NOT_EXECUTED') AS execution_status, action_sql, error_message, reviewer, review_comments,
  executed_at, executed_by, created_at FROM joined)"""


def remediation_inputs(t):
    return d.analysis_cache(t), d.approvals(t), d.audit(t)


@workload("v_pending", f"WITH {PENDING} SELECT * FROM pending")
def v_pending(t):
    return remediation.pending_remediations(*remediation_inputs(t))


@workload("v_history", f"WITH {HISTORY} SELECT * FROM history")
def v_history(t):
    return remediation.remediation_history(*remediation_inputs(t))


@workload("q13_pending", f"""WITH {PENDING} SELECT recommendation_id, check_id, target_table, safety_classification,
  recommendation_status, approval_status, action_status, created_at,
  CASE safety_classification WHEN 'SAFE_TO_AUTOMATE' THEN 'SAFE' WHEN 'REQUIRES_HUMAN_REVIEW' THEN 'HUMAN REVIEW'
    ELSE safety_classification END AS badge FROM pending""")
def q13(t):
    return dashboards.pending_list(remediation.pending_remediations(*remediation_inputs(t)))


@workload("q13_reply", f"WITH {d.CACHE} SELECT ai_response FROM cache WHERE analysis_id = 'A3-1'")
def q13_reply(t):
    return dashboards.reply_text(d.analysis_cache(t), "A3-1")


@workload("q14_history", f"""WITH {HISTORY} SELECT recommendation_id, check_id, target_table, safety_classification,
  recommendation_status, approval_status, execution_status, reviewer, executed_at, created_at FROM history""")
def q14(t):
    return dashboards.history_list(remediation.remediation_history(*remediation_inputs(t)))


@workload("latest_analysis", f"""WITH {d.CACHE} SELECT analysis_type, target_table,
  arg_max(analysis_id, created_at) AS analysis_id, MAX(created_at) AS created_at FROM cache GROUP BY ALL""")
def latest_analysis(t):
    return remediation.latest_analysis(d.analysis_cache(t), ["target_table"])


@workload("replace_analyses", f"""WITH {d.CACHE}, keyed AS (SELECT *, CASE WHEN turn_even THEN 'a' END AS target_column
  FROM (SELECT *, check_id % 2 = 0 AS turn_even FROM cache)),
fresh AS (SELECT DISTINCT analysis_type, run_id, check_id, target_column FROM keyed WHERE check_id > 3)
SELECT analysis_id, analysis_type, run_id, check_id, target_column FROM keyed WHERE check_id <= 3
UNION ALL SELECT 'new', analysis_type, run_id, check_id, target_column FROM fresh""")
def replace_analyses(t):
    keyed = d.analysis_cache(t).select(
        "analysis_id", "analysis_type", "run_id", "check_id",
        F.when(F.col("check_id") % 2 == 0, "a").alias("target_column"))
    fresh = keyed.where("check_id > 3").drop("analysis_id").distinct().withColumn("analysis_id", F.lit("new"))
    return remediation.replace_analyses(keyed, fresh.select(*keyed.columns))


# Bounded execution of an accepted query over registered views; the row bound is the feature.
@workload("bounded_query", f"""WITH {d.RUNS} SELECT target_table, run_id, failed_checks FROM run_log
ORDER BY failed_checks DESC, run_id LIMIT 50""")
def bounded_query(t):
    d.run_log(t).createOrReplaceTempView("dq_run_log")
    reply = ("Here it is:\n```sql\nSELECT target_table, run_id, failed_checks FROM dq_run_log "
             "ORDER BY failed_checks DESC, run_id;\n```")
    query = t.spark.range(1).select(text.extract_query(F.lit(reply)).alias("q")).first().q
    status, message, rows = dashboards.run_query(t.spark, query, text.READABLE_OBJECTS)
    if rows is None:
        raise RuntimeError(f"{status}: {message}")
    return rows


# Reports

REPORT_LINES = """'Check ' || c.check_id || ' on ' || COALESCE(r.target_database, '') || '.' || COALESCE(r.target_schema, '') || '.'
  || c.target_table || ': ' || c.check_name || chr(10) || 'Category ' || l.category || ', severity ' || c.severity
  || chr(10) || 'Purpose: ' || l.description || chr(10) || 'Outcome: ' || c.check_status || ' with ' || c.failure_count || ' of '
  || c.total_rows || ' rows failing, a share of ' || c.failure_pct || chr(10) || 'Limits: warn from ' || c.threshold_warning
  || ' on, fail from ' || c.threshold_fail || ' on' || chr(10)"""
SAMPLE_LINE = """'* ' || record_identifier || ': ' || column_name || ' = ' || failed_value || ', ' || failure_reason"""


def _sample_texts(source):
    return f"""sample_texts AS (SELECT run_id, check_id, column_name, string_agg(line, chr(10) ORDER BY place) AS samples FROM (
  SELECT run_id, check_id, column_name, {SAMPLE_LINE} AS line, ROW_NUMBER() OVER (PARTITION BY run_id, check_id, column_name
    ORDER BY created_at, record_identifier, failed_value, failure_reason) AS place FROM {source}) WHERE place <= 5
  GROUP BY run_id, check_id, column_name)"""


# Runs of the size of a supplier; a check of a run has records of two columns.
def supplier_records(t):
    return t["lineitem"].selectExpr(
        "concat('R', l_suppkey) AS run_id", "CAST(l_linenumber AS BIGINT) AS check_id",
        "CAST(l_orderkey AS STRING) AS record_identifier", "l_linestatus AS column_name",
        "CAST(l_partkey AS STRING) AS failed_value", "concat('check ', l_linenumber) AS failure_reason",
        "l_shipdate AS created_at")


SUPPLIER_RECORDS = """failed AS (SELECT 'R' || l_suppkey AS run_id, CAST(l_linenumber AS BIGINT) AS check_id,
  CAST(l_orderkey AS VARCHAR) AS record_identifier, l_linestatus AS column_name,
  CAST(l_partkey AS VARCHAR) AS failed_value, 'check ' || l_linenumber AS failure_reason, l_shipdate AS created_at FROM lineitem)"""


def report_results(t):
    return d.results(t).drop("target_table").withColumn("target_table", F.concat(F.lit("T"), "total_rows"))


@workload("failure_report", f"""WITH {d.RUNS}, {d.LIBRARY}, {SUPPLIER_RECORDS},
{_sample_texts('failed')}
SELECT c.run_id, c.check_id, c.target_column, COALESCE(r.target_database, '') || '.' || COALESCE(r.target_schema, '') || '.' || c.target_table AS table_fqn,
  {REPORT_LINES} || COALESCE(chr(10) || 'Examples' || chr(10) || samples || chr(10), '') AS report
FROM (SELECT *, 'T' || total_rows AS target_table FROM results) c JOIN library l ON c.check_id = l.check_id
LEFT JOIN run_log r ON c.run_id = r.run_id LEFT JOIN sample_texts s ON c.run_id = s.run_id AND c.check_id = s.check_id AND c.target_column = s.column_name
WHERE c.check_status IN ('FAIL', 'WARNING')""")
def failure_report(t):
    return reports.failure_reports(report_results(t), d.library(t), d.run_rows(t), supplier_records(t))


def report_assignments(t):
    """One assignment per check, table and column of the results, by the smallest order."""
    return t["lineitem"].selectExpr(
        "l_orderkey * 10 + l_linenumber AS assignment_id", "CAST(l_linenumber AS BIGINT) AS check_id",
        "concat('T', l_partkey + l_suppkey) AS target_table", "l_linestatus AS target_column",
        "map('record_id', concat('k', l_orderkey)) AS params", "l_returnflag <> 'N' AS is_active")


@workload("remediation_report", f"""WITH {d.RUNS}, {d.LIBRARY}, {SUPPLIER_RECORDS}, {_sample_texts('failed')},
params AS (SELECT l_linenumber AS check_id, 'T' || (l_partkey + l_suppkey) AS target_table, l_linestatus AS target_column,
  '{{"record_id":"k' || arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) || '"}}' AS params FROM lineitem
  WHERE l_returnflag <> 'N' GROUP BY ALL)
SELECT c.result_id, c.run_id, c.check_id, COALESCE(r.target_database, '') || '.' || COALESCE(r.target_schema, '') || '.' || c.target_table AS table_fqn,
  {REPORT_LINES} || 'Column: ' || c.target_column || chr(10)
  || COALESCE('Parameters: ' || p.params || chr(10), '')
  || COALESCE(chr(10) || 'Examples' || chr(10) || samples || chr(10), '') AS report
FROM (SELECT *, 'T' || total_rows AS target_table FROM results) c JOIN library l ON c.check_id = l.check_id
LEFT JOIN run_log r ON c.run_id = r.run_id LEFT JOIN sample_texts s ON c.run_id = s.run_id AND c.check_id = s.check_id AND c.target_column = s.column_name
LEFT JOIN params p ON p.check_id = c.check_id AND p.target_table = c.target_table AND p.target_column = c.target_column
WHERE c.check_status <> 'PASS'""")
def remediation_report(t):
    return reports.remediation_reports(
        report_results(t), d.library(t), d.run_rows(t), supplier_records(t), report_assignments(t))


def _profile_line(column, numeric):
    tail = f" || ', mean=' || CAST(ROUND(AVG({column}), 4) AS DOUBLE) || ', median=' || CAST(ROUND(MEDIAN({column}), 4) AS DOUBLE)" if numeric else ""
    kind = {"c_custkey": "long", "c_nationkey": "integer", "c_acctbal": "double"}.get(column, "string")
    return (f"SELECT '{column}' AS column_name, '- {column} ({kind}): nulls=0 (0.0%), distinct=' || COUNT(DISTINCT {column}) "
            f"|| ', min=' || MIN(CAST({column} AS VARCHAR)) || ', max=' || MAX(CAST({column} AS VARCHAR)){tail} AS line FROM customer")


# Two snapshots are stored; the report shows the newest.
@workload("profile_report", f"""WITH stats AS ({' UNION ALL '.join(
    _profile_line(c, n) for c, n in (("c_name", False), ("c_mktsegment", False), ("c_custkey", True), ("c_nationkey", True)))}),
dist AS (SELECT c_mktsegment AS v, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM customer), 4) AS p
  FROM customer GROUP BY c_mktsegment)
SELECT 'main.public.customer' AS table_fqn, 'Profile of main.public.customer' || chr(10) || 'taken 2024-01-31 00:00:00' || chr(10)
  || (SELECT COUNT(*) FROM customer) || ' rows in 4 columns' || chr(10) || chr(10) || 'Columns' || chr(10)
  || (SELECT string_agg(line, chr(10) ORDER BY column_name) FROM stats) || chr(10) || chr(10) || 'Values' || chr(10)
  || 'Column c_mktsegment:' || chr(10)
  || (SELECT string_agg('  ' || v || ': ' || n || ' rows (' || CAST(p AS DOUBLE) || '%)', chr(10) ORDER BY n DESC, v) FROM dist)
  || chr(10) AS report""")
def profile_report(t):
    df = t["customer"].select("c_name", "c_mktsegment", "c_custkey", "c_nationkey")
    older, newer = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31)
    few = df.where("c_mktsegment <> 'BUILDING'")
    tables = profiling.table_profile(df, "customer", newer).unionByName(profiling.table_profile(few, "customer", older))
    profiles, values = profiling.column_profiles, profiling.distributions
    columns = profiling.located(profiles(df), "customer", newer).unionByName(
        profiling.located(profiles(few), "customer", older))
    shares = profiling.located(values(df), "customer", newer, "snapshot_at").unionByName(
        profiling.located(values(few), "customer", older, "snapshot_at"))
    return reports.profile_reports(stored(tables, "tables"), stored(columns, "columns"), stored(shares, "values"))


# Statements in which a supplier's name is a relation, a common table expression, a literal or none of them, by key.
STATEMENTS = {
    0: "SELECT 'CTE [x]' AS x FROM dq_run_log, `{n}` s",
    1: "SELECT 1 FROM dq_run_log, `{n}` s, (WITH `{n}` AS (SELECT run_id FROM dq_run_log) SELECT 1 FROM `{n}`) q",
    2: "SELECT 'UnresolvedRelation [{n}]' AS x FROM dq_run_log",
    3: "WITH `{n}` AS (SELECT * FROM t), b AS (SELECT * FROM `{n}`) SELECT * FROM b",
    4: "WITH `{n}` AS (SELECT * FROM `{n}`) SELECT * FROM `{n}`",
    5: "SELECT * FROM IDENTIFIER('{n}')",
    6: "SELECT * FROM parquet.`{n}`",
    7: "SELECT v FROM t WHERE EXISTS (SELECT 1 FROM `{n}` WHERE k IN (SELECT k FROM u)) ORDER BY v",
}


@workload("query_relations", """WITH r AS (SELECT s_suppkey, s_name AS n, s_suppkey % 8 AS k FROM supplier)
SELECT s_suppkey, relation, relation IN ('dq_run_log', 't') AS approved FROM (
  SELECT s_suppkey, unnest(CASE WHEN k < 2 THEN ['dq_run_log', n] WHEN k = 2 THEN ['dq_run_log'] WHEN k = 3 THEN ['t']
    WHEN k = 4 THEN [n] WHEN k = 5 THEN ['IDENTIFIER'] WHEN k = 6 THEN ['parquet.' || n] ELSE ['t', n, 'u'] END) AS relation FROM r)""")
def query_relations(t):
    """What each statement reads. The session parses one statement of those that differ in quoted texts only."""
    text = F.element_at(F.array(*[F.replace(F.lit(s), F.lit("{n}"), F.col("s_name")) for s in STATEMENTS.values()]),
                        (F.col("s_suppkey") % 8 + 1).cast("int"))
    statements = t["supplier"].select("s_suppkey", text.alias("sql"))
    return dashboards.relations_of(statements, ["s_suppkey"], "sql", ["DQ_RUN_LOG", "T"])


# Repairs

@workload("fix_update", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_acctbal < 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def fix_update(t):
    fixed = repair.update_where(
        t["customer"], F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("REVIEW")})
    return fixed.select("c_custkey", "c_acctbal", "c_mktsegment")


@workload("fix_insert", """SELECT c_custkey, c_name, c_acctbal FROM customer
UNION ALL SELECT s_suppkey + 100000000, s_name, NULL FROM supplier""")
def fix_insert(t):
    extra = t["supplier"].select((F.col("s_suppkey") + 100000000).alias("c_custkey"), F.col("s_name").alias("c_name"))
    return repair.insert_rows(t["customer"].select("c_custkey", "c_name", "c_acctbal"), extra)


@workload("fix_merge", f"""WITH perturbed AS ({d.PERTURBED}), changed AS (
  SELECT * FROM perturbed EXCEPT SELECT * FROM orders)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed)
UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM changed""")
def fix_merge(t):
    changed = delta.net_changes(t["orders"], d.perturbed_orders(t)).where("action = 'INSERT'").select(*t["orders"].columns)
    return repair.merge_rows(t["orders"], changed, ["o_orderkey"]).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@workload("fix_replace_values", """SELECT c_custkey, c_name, COALESCE(s_acctbal, c_acctbal) AS c_acctbal
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def fix_replace_values(t):
    values = t["supplier"].select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return repair.replace_values(t["customer"].select("c_custkey", "c_name", "c_acctbal"), values, "c_custkey", "c_acctbal")


# Few customers have an order so dear, so most keys keep their rows.
@workload("fix_replace_by_key", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000)
UNION ALL SELECT o_custkey, o_orderkey, -o_totalprice FROM orders WHERE o_totalprice > 490000""")
def fix_replace_by_key(t):
    orders = t["orders"].select("o_custkey", "o_orderkey", "o_totalprice")
    rows = orders.where("o_totalprice > 490000").withColumn("o_totalprice", -F.col("o_totalprice"))
    return repair.replace_by_key(orders, rows, ["o_custkey"])


@workload("add_column", "SELECT s_suppkey, s_name, CAST(NULL AS VARCHAR) AS supplier_code FROM supplier")
def add_column(t):
    return repair.add_column(t["supplier"], "supplier_code", "string").select("s_suppkey", "s_name", "supplier_code")


# Change feeds and streams

@workload("snapshot_diff", f"""WITH perturbed AS ({d.PERTURBED}),
gone AS (SELECT * FROM orders EXCEPT ALL SELECT * FROM perturbed), fresh AS (SELECT * FROM perturbed EXCEPT ALL SELECT * FROM orders)
SELECT *, 'DELETE' AS action, o_orderkey IN (SELECT o_orderkey FROM fresh) AS is_update, CAST(1 AS BIGINT) AS row_count FROM gone
UNION ALL SELECT *, 'INSERT', o_orderkey IN (SELECT o_orderkey FROM gone), 1 FROM fresh""")
def snapshot_diff(t):
    return delta.change_feed(t["orders"], d.perturbed_orders(t), ["o_orderkey"])


@workload("change_summary", f"""WITH perturbed AS ({d.PERTURBED})
SELECT CASE WHEN o.o_orderkey IS NULL THEN 'INSERT' WHEN p.o_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS change_type,
  COUNT(*) AS row_count FROM orders o FULL JOIN perturbed p ON o.o_orderkey = p.o_orderkey
WHERE o.o_orderkey IS NULL OR p.o_orderkey IS NULL OR o.o_totalprice <> p.o_totalprice GROUP BY 1""")
def change_summary(t):
    return delta.change_summary(t["orders"], d.perturbed_orders(t), ["o_orderkey"])


ROWS_PER_FILE = 1_000_000


def stream_of(t, name, batches=3):
    """The table as a stream: written in files of bounded size, of which each batch reads its share.

    There are as many files as the table has splits, more if their rows are narrow, so no task gets more as it grows.
    """
    path = scratch_path(t.spark, "arriving")
    files = max(batches, t[name].rdd.getNumPartitions(), -(-t[name].count() // ROWS_PER_FILE))
    t[name].repartition(files).write.parquet(path)
    return t.spark.readStream.schema(t[name].schema).option("maxFilesPerTrigger", -(-files // batches)).parquet(path)


def finished(t, stream, transform, label, output_mode="append"):
    """Drain the stream into a fresh folder and read that back."""
    path = scratch_path(t.spark, label)
    feeds.write_batches(stream, transform, f"{path}/out", f"{path}/state", output_mode).awaitTermination()
    return t.spark.read.parquet(f"{path}/out")


EVENT_SPECS = [
    spec(9, "events", "event_type", record_id="event_id", allowed_values="'view','click','signup'"),
    spec(6, "events", "value", record_id="event_id", min_value=1, max_value=30),
    spec(12, "events", "ts", record_id="event_id", timestamp_column="ts", max_staleness_days=20),
]


@workload("stream_checks", """SELECT CAST(check_id AS BIGINT) AS check_id, CAST(n AS BIGINT) AS failure_count, CAST(total AS BIGINT) AS total_rows,
  CASE WHEN n = 0 THEN 'PASS' WHEN n >= fail THEN 'FAIL' WHEN n >= warn THEN 'WARNING' ELSE 'FAIL' END AS check_status FROM (
  SELECT 9 AS check_id, COUNT(*) FILTER (event_type NOT IN ('view','click','signup')) AS n, COUNT(*) AS total, 1 AS warn, 5 AS fail FROM events
  UNION ALL SELECT 6, COUNT(*) FILTER (value < 1 OR value > 30), COUNT(*), 1, 5 FROM events
  UNION ALL SELECT 12, COUNT(*) FILTER (date_diff('day', ts, TIMESTAMP '2024-01-31') > 20), COUNT(*), 0, 1 FROM events)""")
def stream_checks_query(t):
    path = scratch_path(t.spark, "checks")
    stream_checks.check_batches(
        t.spark, stream_of(t, "events"), "events", EVENT_SPECS, dt.datetime(2024, 1, 31), f"{path}/out", f"{path}/state"
    ).awaitTermination()
    return t.spark.read.parquet(f"{path}/out").groupBy("check_id", "check_status").agg(
        F.sum("failure_count").alias("failure_count"), F.sum("total_rows").alias("total_rows"))


GROUP_SPECS = [
    spec(2, "events", "user_id"),
    spec(3, "events", columns="user_id, event_type", where_clause="WHERE event_type <> 'view'"),
    spec(19, "events", file_column="props"),
    spec(25, "events", cdc_op_column="event_type", record_id="event_id", duplicate_keys="user_id, event_type",
         group_filter="value > 20", row_filter="event_type = 'click'"),
]
WINDOWED = """(SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS window_start FROM events)"""


@workload("stream_dup_keys", f"""SELECT * FROM (
  SELECT window_start, 0 AS check_number, '{{"user_id":' || COALESCE(CAST(user_id AS VARCHAR), 'null') || '}}' AS group_key,
    COUNT(*) AS occurrences, COUNT(*) AS failing FROM {WINDOWED} GROUP BY window_start, user_id
  UNION ALL SELECT window_start, 1, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}', COUNT(*), COUNT(*)
    FROM {WINDOWED} WHERE event_type <> 'view' GROUP BY window_start, user_id, event_type
  UNION ALL SELECT window_start, 2, '{{"props":"' || replace(props, '"', '\\"') || '"}}', COUNT(*), COUNT(*)
    FROM {WINDOWED} WHERE props IS NOT NULL GROUP BY window_start, props
  UNION ALL SELECT window_start, 3, '{{"user_id":' || user_id || ',"event_type":"' || event_type || '"}}',
    COUNT(*) FILTER (value > 20), COUNT(*) FILTER (event_type = 'click') FROM {WINDOWED} GROUP BY window_start, user_id, event_type)
WHERE occurrences > 1 AND failing > 0""")
def stream_dup_keys(t):
    """Group checks over arriving events; files come in any order, so the watermark stays behind all of them."""
    path = scratch_path(t.spark, "groups")
    group_checks.check_groups(
        stream_of(t, "events"), GROUP_SPECS, "ts", "1 day", "400 days", f"{path}/out", f"{path}/state").awaitTermination()
    return group_checks.standing(t.spark.read.parquet(f"{path}/out"))


@workload("change_feed", f"""WITH {d.RESULTS} SELECT check_status, severity, COUNT(*) AS n FROM results
WHERE check_status <> 'PASS' GROUP BY ALL""")
def change_feed(t):
    columns = [f"{e} AS {n}" for n, e in d.RESULT_COLUMNS.items()]
    results = stream_of(t, "lineitem").selectExpr(*columns)
    fed = finished(t, results, feeds.result_feed, "results")
    return fed.groupBy("check_status", "severity").agg(F.count(F.lit(1)).alias("n"))


@workload("drift_feed", f"""{DRIFT_SUMMARY} WHERE n.snapshot_at IS NOT NULL""")
def drift_feed(t):
    """Drift of the tables of each batch of new snapshots; the last report of a table stands."""
    lines = stream_of(t, "lineitem")
    report = feeds.drift_feed(d.current_columns(t), lambda: d.snapshots_of(t["lineitem"]))
    reports = finished(t, lines, lambda batch: report(d.snapshots_of(batch)), "drift")
    values = [c for c in reports.columns if c not in ("batch_id", "table_schema", "table_name")]
    last = F.max_by(F.struct(*values), "batch_id").alias("last")
    return reports.groupBy("table_schema", "table_name").agg(last).select("table_schema", "table_name", "last.*")


@workload("recommendation_feed", f"""WITH {d.CACHE} SELECT analysis_type, {WHOLE_WORDS} AS safety_classification, COUNT(*) AS n
FROM cache GROUP BY ALL""")
def recommendation_feed(t):
    cache = d.cache_of(stream_of(t, "conversations")).withColumn("recommendation_text", F.col("ai_response"))
    fed = finished(t, cache, feeds.recommendation_feed, "recommendations")
    return fed.groupBy("analysis_type", "safety_classification").agg(F.count(F.lit(1)).alias("n"))


@workload("audit_feed", f"WITH {d.AUDIT} SELECT status, COUNT(*) AS executions FROM audit GROUP BY status")
def audit_feed(t):
    counts = feeds.audit_status_counts(d.audit_of(stream_of(t, "documents")))
    told = finished(t, counts, lambda batch: batch, "audit", "complete")
    # Each batch tells all counts so far; the last one stands.
    return told.where(F.col("batch_id") == told.select("batch_id").agg(F.max("batch_id").alias("m")).scalar()).drop("batch_id")


@workload("score_documents", f"""WITH {d.SCORES} SELECT run_id, run_id AS named, target_table, health_score, total_checks,
  passed_checks AS passed, failed_checks AS failed, critical_failures AS critical, high_failures AS high,
  medium_failures AS medium, low_failures AS low FROM scores""")
def score_documents(t):
    documents = health.score_document(d.scores(t))
    counts = ["total_checks", "passed", "failed", "critical", "high", "medium", "low"]
    parsed = F.from_json("document", "run_id string, target_table string, health_score double, " + ", ".join(
        f"{c} bigint" for c in counts))
    return documents.select("run_id", parsed.alias("p")).select(
        "run_id", F.col("p.run_id").alias("named"), "p.target_table", "p.health_score", *[f"p.{c}" for c in counts])


