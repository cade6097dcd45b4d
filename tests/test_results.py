"""Configuration, health, views, remediation and reports on small frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.config import library, specs
from plumbline.functions.predicates import as_of_column
from plumbline.plans import dashboards, health, incremental, remediation, reports
from tests import planted

DAY = dt.datetime(2024, 1, 1)


def rows_of(spark, schema, *rows):
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def result(run, check, status, severity="HIGH", weight="1.50", **more):
    return dict(result_id=f"{run}-{check}-{more.get('target_column')}", run_id=run, check_id=check, check_name=f"check {check}",
                target_table="t", check_status=status, total_rows=10, failure_count=1, failure_pct=Decimal("0.1"),
                severity=severity, weight=Decimal(weight), created_at=DAY, **more)


def test_library(spark):
    checks = library.library_frame(spark).collect()
    assert [r.check_id for r in checks] == list(range(1, 26))
    assert len({r.category for r in checks}) == 11 and sum(r.is_ai_check for r in checks) == 5
    assert sum(r.weight for r in checks) == Decimal("35.00")
    assert library.threshold_frame(spark).count() == 25


def test_assignments_resolve_to_the_same_specs(spark):
    wanted = planted.specs()
    loaded = specs.load_specs(
        specs.assignment_frame(spark, wanted), library.library_frame(spark), library.threshold_frame(spark))
    key = lambda s: (s.target_table, s.check_id, s.target_column or "", sorted(s.params.items()))
    assert len(loaded) == 42 and sorted(map(key, loaded)) == sorted(map(key, wanted))
    assert {s.check_id: (s.severity, s.weight, s.warning, s.fail) for s in loaded} == {
        s.check_id: (s.severity, s.weight, s.warning, s.fail) for s in wanted}


def test_inactive_and_doubled_settings(spark):
    wanted = [specs.spec(1, "t", "a", record_id="id"), specs.spec(2, "t", "a"), specs.spec(3, "t", columns="a")]
    assignments = specs.assignment_frame(spark, wanted).withColumn("is_active", F.col("check_id") != 3)
    checks = library.library_frame(spark).withColumn("is_active", F.col("check_id") != 2)
    limits = library.threshold_frame(spark)
    doubled = limits.unionByName(limits)
    assert [s.check_id for s in specs.load_specs(assignments, checks, doubled)] == [1, 1]
    off = limits.withColumn("is_active", F.lit(False))
    assert [s.fail for s in specs.load_specs(assignments, checks, off)] == [None]


def test_params_come_from_json(spark):
    df = spark.createDataFrame([('{"record_id":"id","max_value":"5"}',), ("{}",)], "params_json string")
    assert [r.params for r in specs.parse_params(df).collect()] == [{"record_id": "id", "max_value": "5"}, {}]


def test_health_score(spark):
    results = rows_of(
        spark, schemas.CHECK_RESULTS,
        result("a", 1, "PASS"), result("a", 2, "WARNING", "CRITICAL", "2.00"), result("a", 3, "FAIL", "LOW", "0.75"),
        result("a", 4, "ERROR", "CRITICAL", "2.00"), result("b", 1, "ERROR"),
        result("c", 1, "FAIL", weight="0.00"),
    )
    found = {r.run_id: r for r in health.health_scores(results).collect()}
    assert set(found) == {"a", "c"}
    a = found["a"]
    assert (a.health_score, a.total_checks, a.passed_checks, a.failed_checks) == (Decimal("58.82"), 3, 1, 2)
    assert (a.critical_failures, a.high_failures, a.medium_failures, a.low_failures) == (1, 0, 0, 1)
    assert found["c"].health_score == Decimal("100.00")


def runs(spark, *rows):
    return rows_of(spark, schemas.RUN_LOG, *[
        dict(run_id=i, run_start_time=t, target_database="d", target_schema="s", target_table=table, total_checks=2,
             passed_checks=1, failed_checks=f, overall_status="COMPLETED") for i, t, table, f in rows])


def scored(spark, *rows):
    return rows_of(spark, schemas.HEALTH_SCORES, *[
        dict(run_id=i, target_table=table, health_score=Decimal(s), total_checks=2, passed_checks=1, failed_checks=1,
             critical_failures=0, high_failures=0, medium_failures=0, low_failures=0) for i, table, s in rows])


def test_views_over_runs(spark):
    log = runs(spark, ("a", DAY, "t", 1), ("b", DAY, "u", 1), ("x", DAY, "v", 0))
    scores = scored(spark, ("a", "t", "89.99"), ("b", "u", "90.00"))
    failed = rows_of(spark, schemas.FAILED_RECORDS, *[dict(run_id="a", check_id=1)] * 3)
    table = {r.run_id: r for r in health.table_health(scores, log, failed).collect()}
    assert (table["a"].failed_record_count, table["b"].failed_record_count, table["a"].warning_checks) == (3, 0, 0)
    row = dashboards.overall_with_light(health.overall_health(scores, log, failed)).first()
    assert (row.overall_health_score, row.overall_status, row.light) == (Decimal("90.00"), "WARNING", "green")
    assert (row.tables_evaluated, row.total_failed_records) == (2, 3)
    nothing = dashboards.overall_with_light(health.overall_health(scores.limit(0), log, failed)).first()
    assert (nothing.overall_status, nothing.light, nothing.total_failed_records) == ("CRITICAL", "red", 0)


def test_score_changes(spark):
    day = lambda n: DAY + dt.timedelta(days=n)
    log = runs(spark, ("a1", day(0), "a", 2), ("a2", day(2), "a", 1), ("a3", day(3), "a", 0), ("b1", day(0), "b", 1),
               ("b2", day(2), "b", 1), ("c1", day(0), "c", 1), ("d1", day(0), "d", 1), ("d2", day(2), "d", 1))
    scores = scored(spark, ("a1", "a", "50.00"), ("a2", "a", "40.00"), ("a3", "a", "50.02"), ("b1", "b", "60.00"),
                    ("c1", "c", "10.00"), ("d1", "d", "10.00"), ("d2", "d", "9.99"))
    found = {r.target_table: r for r in health.score_changes(scores, log, as_of_column(day(1))).collect()}
    assert set(found) == {"a", "b", "d"}
    assert (found["a"].rerun_run_id, found["a"].improvement_status) == ("a3", "IMPROVED")
    assert (found["b"].score_change, found["b"].improvement_status, found["b"].rerun_health_score) == (0, "UNCHANGED", None)
    assert found["d"].improvement_status == "UNCHANGED"


def cache(spark, *rows):
    return rows_of(spark, schemas.ANALYSIS_CACHE, *[
        {**dict(analysis_type=remediation.RECOMMENDATION, run_id="r", check_id=1, target_table="t", status="COMPLETED",
                created_at=DAY, ai_response="?"), **row} for row in rows])


FENCED = "SAFE_TO_AUTOMATE\n```sql\n{}\n```"


def remediation_inputs(spark):
    replies = cache(
        spark,
        dict(analysis_id="1", ai_response=FENCED.format("UPDATE t SET a = 1")),
        dict(analysis_id="2", ai_response="requires_human_review"),
        dict(analysis_id="3", ai_response=FENCED.format("DROP TABLE t; --")),
        dict(analysis_id="4", ai_response=FENCED.format("UPDATE t SET b = 2")),
        dict(analysis_id="5", ai_response="SAFE_TO_AUTOMATE but no statement"),
        dict(analysis_id="6", analysis_type=remediation.PROFILE, ai_response="SAFE_TO_AUTOMATE"),
        dict(analysis_id="7"),
    )
    approvals = rows_of(spark, schemas.APPROVAL_QUEUE,
                        dict(recommendation_id="2", approval_status="APPROVED", requested_at=DAY, reviewer="ann"),
                        dict(recommendation_id="3", approval_status="REJECTED", requested_at=DAY))
    audit = rows_of(spark, schemas.REMEDIATION_AUDIT,
                    dict(audit_id="a", analysis_id="4", status="FAILED", executed_at=DAY),
                    dict(audit_id="b", analysis_id="4", status="SUCCESS", executed_at=DAY + dt.timedelta(1)))
    return replies, approvals, audit


def test_remediation_views(spark):
    replies, approvals, audit = remediation_inputs(spark)
    pending = remediation.pending_remediations(replies, approvals, audit).collect()
    assert sorted((r.recommendation_id, r.action_status, r.approval_status) for r in pending) == [
        ("1", "SAFE_READY", "AUTO_ELIGIBLE"), ("2", "APPROVED_PENDING_EXECUTION", "APPROVED"), ("3", "REJECTED", "REJECTED"),
        ("4", "APPLIED", "AUTO_ELIGIBLE"), ("4", "EXECUTION_FAILED", "AUTO_ELIGIBLE"), ("5", "SAFE_READY", "AUTO_ELIGIBLE"),
        ("7", "PENDING", "AWAITING_REVIEW")]
    history = remediation.remediation_history(replies, approvals, audit).collect()
    assert sorted((r.recommendation_id, r.execution_status, r.approval_status) for r in history if r.recommendation_id in "24") == [
        ("2", "NOT_EXECUTED", "APPROVED"), ("4", "FAILED", "N/A"), ("4", "SUCCESS", "N/A")]


def test_apply_decisions_and_audit(spark):
    replies, _, audit = remediation_inputs(spark)
    decisions = remediation.apply_decisions(replies, audit)
    assert {r.recommendation_id: r.status for r in decisions.collect()} == {
        "1": "READY", "2": "SKIPPED", "3": "BLOCKED", "4": "ALREADY_APPLIED", "5": "ERROR", "6": "ERROR", "7": "SKIPPED"}
    outcomes = spark.createDataFrame([("1", None), ("2", None)], "recommendation_id string, error_message string")
    written = remediation.audit_rows(decisions, outcomes, DAY, "robot").collect()
    assert [(r.analysis_id, r.status, r.action_sql) for r in written] == [("1", "SUCCESS", "UPDATE t SET a = 1")]
    again = remediation.apply_decisions(replies, audit.unionByName(
        spark.createDataFrame(written, schemas.REMEDIATION_AUDIT)))
    assert again.where("recommendation_id = '1'").first().status == "ALREADY_APPLIED"


def test_analyses_of_two_columns_do_not_replace_each_other(spark):
    stored = cache(spark, dict(analysis_id="1", target_column="a"), dict(analysis_id="2", target_column=None))
    fresh = cache(spark, dict(analysis_id="3", target_column="a"), dict(analysis_id="4", target_column="b"))
    left = remediation.replace_analyses(stored, fresh).collect()
    assert sorted(r.analysis_id for r in left) == ["2", "3", "4"]
    newest = remediation.latest_analysis(stored.unionByName(fresh), ["run_id", "check_id"]).first()
    assert newest.analysis_id == "4"


def test_incremental_selection(spark):
    now = dt.datetime(2024, 1, 1, 12)
    hours = lambda n: now - dt.timedelta(hours=n)
    log = runs(spark, ("new", hours(1), "t", 1), ("edge", hours(2), "t", 0), ("old", hours(3), "t", 1),
               ("done", hours(1), "t", 1))
    scores = scored(spark, ("done", "t", "1.00"))
    assert sorted(r.run_id for r in incremental.unscored_runs(log, scores, now).collect()) == ["edge", "new"]
    explained = cache(spark, dict(analysis_id="1", run_id="new", analysis_type=remediation.EXPLANATION),
                      dict(analysis_id="2", run_id="done"))
    assert [r.run_id for r in incremental.unexplained_runs(log, explained, now).collect()] == ["done"]


def test_reports(spark):
    results = rows_of(spark, schemas.CHECK_RESULTS, result("a", 1, "FAIL", target_column="c"), result("a", 2, "PASS"),
                      result("a", 3, "ERROR"))
    log = runs(spark, ("a", DAY, "t", 1))
    failed = rows_of(spark, schemas.FAILED_RECORDS, *[
        dict(run_id="a", check_id=1, record_identifier=str(i), column_name="c", failed_value="x", failure_reason="bad",
             created_at=DAY) for i in range(9)])
    checks = library.library_frame(spark)
    found = reports.failure_reports(results, checks, log, failed).collect()
    assert [(r.check_id, r.table_fqn) for r in found] == [(1, "d.s.t")]
    assert found[0].report.count("\n* ") == 5 and "\nCategory Completeness, severity HIGH\n" in found[0].report
    assert "\nLimits: warn from null on, fail from null on\n" in found[0].report
    assigned = specs.assignment_frame(spark, [specs.spec(1, "t", "other", record_id="x"), specs.spec(1, "t", "c", record_id="id")])
    fixes = {r.check_id: r.report for r in reports.remediation_reports(results, checks, log, failed, assigned).collect()}
    assert set(fixes) == {1, 3}
    assert 'Column: c\nParameters: {"record_id":"id"}\n' in fixes[1] and "Parameters" not in fixes[3]


def test_reports_show_the_records_of_their_own_column(spark):
    results = rows_of(spark, schemas.CHECK_RESULTS, *[result("a", 1, "FAIL", target_column=c) for c in "uv"])
    failed = rows_of(spark, schemas.FAILED_RECORDS, *[
        dict(run_id="a", check_id=k, record_identifier=f"{c}{i}", column_name=c, failed_value="x", failure_reason="bad",
             created_at=DAY) for k, c in ((1, "u"), (1, "v"), (20, "v")) for i in range(120)])
    many = results.unionByName(rows_of(spark, schemas.CHECK_RESULTS, result("a", 20, "FAIL", target_column="v")))
    found = reports.failure_reports(many, library.library_frame(spark), runs(spark, ("a", DAY, "t", 1)), failed).collect()
    for r in found:
        shown = [line for line in r.report.split("\n") if line.startswith("* ")]
        assert len(shown) == 5 and all(line.startswith(f"* {r.target_column}") for line in shown)
    assert len(found) == 3

@pytest.mark.parametrize("category,count", [(None, 25), ("Integrity", 4)])
def test_catalog(spark, category, count):
    found = dashboards.check_catalog(library.library_frame(spark), category).collect()
    assert len(found) == count and {r.status for r in found} == {"Active"}


def test_configuration_pages(spark):
    assigned = specs.assignment_frame(spark, planted.specs())
    checks = library.library_frame(spark)
    assert dashboards.monitored_list(assigned).count() == 8
    assert dashboards.active_assignments(assigned, checks).count() == 42
    assert dashboards.threshold_list(library.threshold_frame(spark), checks).first().threshold_name == "null_pct"
    assert incremental.monitored_tables(assigned).where("table_fqn = 'main.public.orders'").count() == 1
