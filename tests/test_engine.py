"""The engine: sharing, isolation, samples and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.config.specs import spec
from plumbline.plans import engine
from plumbline.plans.binding import FrameCheck, KeyedCheck, RowCheck, TableContext
from plumbline.sources.tables import Tables, parquet_tables
from plumbline.workloads.result_level import RUN_CHECKS, run_specs

AS_OF = dt.datetime(2024, 1, 31)


def context(spark, rows, ddl, **others):
    frames = {"t": spark.createDataFrame(rows, ddl), **others}
    return TableContext(Tables(spark, frames), "t", AS_OF)


def outcome(plan):
    return {(r.check_id, r.target_column): (r.check_status, r.failure_count, r.total_rows)
            for r in engine.check_results(plan).collect()}


@pytest.mark.parametrize("table", list(RUN_CHECKS))
def test_fused_equals_separate(spark, sf_dir, table):
    plan = engine.plan_table(
        TableContext(parquet_tables(spark, sf_dir), table, AS_OF), [s for s in run_specs() if s.target_table == table])
    together = outcome(plan)
    for check in plan.bound:
        alone = outcome(engine.TablePlan(plan.ctx, plan.run_id, [check]))
        assert alone.items() <= together.items()


def test_row_checks_share_one_scan(spark, sf_dir):
    ctx = TableContext(parquet_tables(spark, sf_dir), "customer", AS_OF)
    specs = [s for s in run_specs() if s.target_table == "customer" and s.check_id in (1, 6, 8, 9, 20)]
    plan = engine.check_results(engine.plan_table(ctx, specs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan


def test_equal_keys_share_one_shuffle(spark, sf_dir):
    ctx = TableContext(parquet_tables(spark, sf_dir), "part", AS_OF)
    specs = [spec(2, "part", "p_name"), spec(19, "part", "p_name", file_column="p_name"),
             spec(3, "part", columns="p_name")]
    plan = engine.check_results(engine.plan_table(ctx, specs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1


def test_sample_limit_is_applied_before_the_shuffle(spark, sf_dir):
    ctx = TableContext(parquet_tables(spark, sf_dir), "customer", AS_OF)
    plan = engine.plan_table(ctx, [spec(20, "customer", "c_acctbal", record_id="c_custkey")])
    text = engine.failed_records(plan)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Partial" in text


def test_unanalysable_check_is_isolated(spark):
    ctx = context(spark, [(1, None), (2, "b")], "id bigint, v string")
    plan = engine.plan_table(ctx, [
        spec(1, "t", "v", record_id="id"), spec(1, "t", "nope", record_id="id"),
        spec(10, "t", "v", record_id="id", rule_expression="this is not sql"), spec(8, "t", "v", record_id="id"),
        spec(17, "t"),
    ])
    found = outcome(plan)
    assert found[1, "v"] == ("FAIL", 1, 2)
    assert all(found[k][:2] == ("ERROR", 0) for k in [(1, "nope"), (10, "v"), (8, "v"), (17, None)])
    messages = {r.check_id: r.error_message for r in engine.check_results(plan).collect()}
    assert "pattern" in messages[8] and len(messages[10]) <= engine.ERROR_LENGTH


def test_failing_job_is_isolated(spark):
    ctx = context(spark, [(1, "x", 0), (2, "7", 1)], "id bigint, v string, n int")
    plan = engine.plan_table(ctx, [
        spec(1, "t", "v", record_id="id"), spec(10, "t", "n", record_id="id", rule_expression="1 / n > 5"),
        spec(10, "t", "v", record_id="id", rule_expression="CAST(v AS INT) > 5"), spec(2, "t", "id"),
    ])
    run = engine.execute_table(plan)
    found = {(r["check_id"], r["target_column"]): r["check_status"] for r in run.rows}
    assert found == {(1, "v"): "PASS", (2, "id"): "PASS", (10, "n"): "ERROR", (10, "v"): "ERROR"}
    results = spark.createDataFrame([tuple(r[c] for c in engine.schemas.CHECK_RESULTS.fieldNames()) for r in run.rows],
                                    engine.schemas.CHECK_RESULTS)
    summary = engine.run_summary(results, F.lit(AS_OF), F.lit(AS_OF)).first()
    assert (summary.total_checks, summary.passed_checks, summary.failed_checks, summary.overall_status) == (
        4, 2, 0, "COMPLETED_WITH_ERRORS")


def test_unreadable_table_does_not_stop_the_others(spark):
    good = spark.createDataFrame([(1, None)], "id bigint, v string")
    tables = Tables(spark, {"good": good})
    contexts = [TableContext(tables, "good", AS_OF), TableContext(tables, "absent_table", AS_OF)]
    out = engine.run_all(spark, contexts, [spec(1, "good", "v", record_id="id"),
                                           spec(1, "absent_table", "v", record_id="id")])
    states = {r.target_table: r.status for r in out.summary.collect()}
    assert states["good"] == "COMPLETED" and states["absent_table"].startswith("ERROR")
    document = engine.run_all_document(out.summary).first().document
    assert '"overall_status":"COMPLETED_WITH_ERRORS"' in document and '"tables_failed":1' in document


def test_empty_table_passes(spark):
    ctx = context(spark, [], "id bigint, v string, n double")
    plan = engine.plan_table(ctx, [
        spec(1, "t", "v", record_id="id"), spec(2, "t", "id"), spec(15, "t", "v", max_pct=10),
        spec(16, "t", "n", record_id="id", z_threshold=3), spec(3, "t", columns="id,v"),
    ])
    assert set(outcome(plan).values()) == {("PASS", 0, 0)}
    assert engine.failed_records(plan).count() == 0


def test_constant_column_has_no_outliers(spark):
    for rows in ([(i, 5.0) for i in range(50)], [(1, 5.0)]):
        plan = engine.plan_table(context(spark, rows, "id bigint, n double"),
                                 [spec(16, "t", "n", record_id="id", z_threshold=1)])
        assert outcome(plan)[16, "n"][0] == "PASS"


def test_samples_are_the_first_hundred(spark):
    rows = [(f"{i:04d}", None) for i in range(500)]
    plan = engine.plan_table(context(spark, rows, "id string, v string"), [spec(1, "t", "v", record_id="id")])
    kept = sorted(r.record_identifier for r in engine.failed_records(plan).collect())
    assert kept == [f"{i:04d}" for i in range(100)]


def test_copies_count_towards_the_sample_limit(spark):
    parent = spark.createDataFrame([(1,)], "id bigint")
    rows = [(1,)] * 5 + [(7,)] * 80 + [(8,)] * 80 + [(None,)]
    ctx = context(spark, rows, "fk bigint", parent=parent)
    plan = engine.plan_table(ctx, [spec(4, "t", "fk", fk_column="fk", parent_table="parent", pk_column="id")])
    assert outcome(plan)[4, "fk"] == ("FAIL", 160, 166)
    kept = [r.record_identifier for r in engine.failed_records(plan).collect()]
    assert (kept.count("7"), kept.count("8")) == (80, 20)


def test_two_uses_of_one_check_stay_apart(spark):
    rows = [(1, "a", "b"), (1, "a", "c"), (2, "a", "c")]
    plan = engine.plan_table(context(spark, rows, "id bigint, x string, y string"), [
        spec(3, "t", columns="x"), spec(3, "t", columns="id,x"), spec(3, "t", columns="x,y")])
    results = engine.check_results(plan).collect()
    assert len({r.result_id for r in results}) == 3
    assert sorted(r.failure_count for r in results) == [1, 1, 1]


def test_null_keys_form_one_group(spark):
    rows = [(None,), (None,), (1,)]
    plan = engine.plan_table(context(spark, rows, "id bigint"),
                             [spec(2, "t", "id"), spec(19, "t", "id", file_column="id")])
    found = outcome(plan)
    assert found[2, "id"][1] == 1 and found[19, "id"][1] == 0


def test_long_keys_are_counted_by_fingerprint(spark):
    text = "x" * 5000
    rows = [(text,), (text,), (text + "y",), ("short",), ("short",)]
    plan = engine.plan_table(context(spark, rows, "v string"), [spec(2, "t", "v"), spec(3, "t", columns="v")])
    assert {v[1] for v in outcome(plan).values()} == {2}
    assert sorted(len(r.record_identifier) for r in engine.failed_records(plan).collect()) == [5, 5000]


def test_shapes(spark, sf_dir):
    ctx = TableContext(parquet_tables(spark, sf_dir), "orders", AS_OF)
    shapes = {type(c) for c in engine.plan_table(ctx, [s for s in run_specs() if s.target_table == "orders"]).bound}
    assert shapes == {RowCheck, KeyedCheck, FrameCheck}


def test_repeated_run_has_the_same_ids(spark):
    ctx = context(spark, [(1, None)], "id bigint, v string")
    ids = [
        [r.result_id for r in engine.check_results(engine.plan_table(ctx, [spec(1, "t", "v", record_id="id")])).collect()]
        for _ in range(2)
    ]
    assert ids[0] == ids[1]
