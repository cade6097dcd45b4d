"""Outcomes of the 42 checks on the planted tables, and the health scores that follow."""

import datetime as dt
from decimal import Decimal

import pytest

from plumbline.functions.predicates import as_of_column
from plumbline.operators.schema_checks import schema_frame, schema_snapshot
from plumbline.plans import engine, health
from plumbline.plans.binding import TableContext
from plumbline.sources.tables import Tables
from tests import planted


@pytest.fixture(scope="module")
def run(spark):
    frames = planted.frames(spark)
    baseline = schema_snapshot(
        schema_frame(spark, frames["products"].schema, "products"), None, dt.datetime(2024, 1, 1)
    )
    frames["products"] = frames["products"].selectExpr("*", "CAST(NULL AS STRING) AS supplier_code")
    tables = Tables(spark, frames)
    contexts = [TableContext(tables, name, planted.AS_OF, baseline) for name in planted.TABLES]
    out = engine.run_all(spark, contexts, planted.specs())
    out.results.cache(), out.run_log.cache()
    return out


def test_counts_and_statuses(run):
    found = {}
    for r in run.results.collect():
        found.setdefault(r.target_table, {})[r.check_id, r.target_column] = (r.failure_count, r.check_status)
    assert found == {table: outcome for table, (outcome, _) in planted.OUTCOMES.items()}
    assert sum(len(v) for v in found.values()) == 42


def test_scores(run):
    scores = {r.target_table: r.health_score for r in health.health_scores(run.results).collect()}
    assert scores == {table: Decimal(score) for table, (_, score) in planted.OUTCOMES.items()}


def test_overall(run):
    scores = health.health_scores(run.results, as_of_column(planted.AS_OF))
    row = health.overall_health(scores, run.run_log, run.failed_records).first()
    assert (row.overall_health_score, row.overall_status) == (Decimal("11.61"), "CRITICAL")
    assert (row.tables_evaluated, row.total_checks, row.passed_checks, row.failed_checks) == (8, 42, 0, 42)


def test_samples(run):
    rows = {(r.target_table, r.check_id, r.column_name): r for r in run.failed_records.collect()}
    assert rows["orders", 4, "customer_id"].record_identifier == "999"
    assert rows["customers", 8, "email"].failed_value == "no mailbox here"
    assert rows["orders", 13, "N/A"].failed_value == "N/A"
    assert ("employees", 15, "department") not in rows


def test_summary_document(run):
    text = engine.run_all_document(run.summary).first().document
    assert '"tables_processed":8' in text and '"overall_status":"COMPLETED"' in text
