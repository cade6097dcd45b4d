"""Run, store, score, repair, rerun, compare and read through the views."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from plumbline.config import specs as config
from plumbline.config.library import library_frame
from plumbline.config.specs import spec
from plumbline.functions.text import READABLE_OBJECTS
from plumbline.operators import repair
from plumbline.plans import lifecycle
from plumbline.plans.binding import TableContext
from plumbline.plans.dashboards import relations_read, run_query
from plumbline.session import scratch_path
from plumbline.sources.store import ResultStore
from plumbline.sources.tables import Tables

AS_OF = dt.datetime(2024, 1, 31, 10)


def test_whole_cycle(spark):
    rows = spark.createDataFrame([(1, None, -1.0), (2, "b", 2.0), (2, "c", 3.0)], "id bigint, v string, n double")
    frames = {"t": rows, "u": spark.createDataFrame([(1,)], "id bigint")}
    checks = [spec(1, "t", "v", record_id="id"), spec(2, "t", "id"), spec(20, "t", "n", record_id="id"),
              spec(2, "u", "id"), spec(1, "u", "absent", record_id="id")]

    def contexts():
        return [TableContext(Tables(spark, frames), name, AS_OF) for name in frames]

    store = ResultStore(spark, scratch_path(spark, "cycle"))
    assert store.read("run_log").count() == 0
    for _ in range(2):
        lifecycle.run_and_store(spark, store, contexts(), checks)
        assert (store.read("check_results").count(), store.read("run_log").count()) == (5, 2)
        assert store.read("failed_records").count() == 3
    first = {r.target_table: r.health_score for r in lifecycle.score_new_runs(store, AS_OF).collect()}
    assert first == {"t": Decimal("0.00"), "u": Decimal("100.00")}
    assert lifecycle.score_new_runs(store, AS_OF).count() == 0

    frames["t"] = repair.update_where(rows, F.col("v").isNull(), {"v": F.lit("?"), "n": F.lit(0.0)})
    later = AS_OF + dt.timedelta(hours=1)
    changes = {r.target_table: r for r in lifecycle.rerun_and_compare(spark, store, contexts(), checks, later).collect()}
    assert (changes["t"].improvement_status, changes["t"].rerun_health_score) == ("IMPROVED", Decimal("55.56"))
    assert changes["u"].improvement_status == "UNCHANGED"
    assert store.read("run_log").where("overall_status = 'COMPLETED_WITH_ERRORS'").count() == 2

    for name in frames:
        receipt = lifecycle.profile_and_store(store, TableContext(Tables(spark, frames), name, AS_OF)).first().receipt
        assert f'"table":"{name}"' in receipt
    assert store.read("column_profiles").count() == 4
    assert sorted(r.snapshot_id for r in store.read("schema_snapshots").collect()) == [1, 2, 3, 4]

    names = lifecycle.register_views(store, library_frame(spark))
    assert sorted(n.upper() for n in names) == sorted(READABLE_OBJECTS)
    assert spark.table("v_pending_remediations").count() == 0
    sql = "SELECT target_table, health_score FROM v_table_health_dashboard ORDER BY health_score, target_table"
    status, _, found = run_query(spark, sql, READABLE_OBJECTS)
    assert status == "SUCCESS" and [r.target_table for r in found.collect()] == ["t", "t", "u", "u"]


def test_assignments_file(spark):
    path = scratch_path(spark, "config")
    spark.createDataFrame([(
        '{"assignment_id":1,"check_id":20,"target_database":"d","target_schema":"s","target_table":"t",'
        '"target_column":"n","params":{"record_id":"id"},"is_active":true}',)], "value string").write.text(path)
    row = config.read_assignments(spark, path).first()
    assert (row.check_id, row.params, row.is_active) == (20, {"record_id": "id"}, True)


def test_queries_read_only_what_is_approved(spark):
    """Names are told apart by scope; literals, quoted names, file formats and computed names do not slip through."""
    spark.createDataFrame([(1,)], "id int").createOrReplaceTempView("dq_run_log")
    spark.createDataFrame([("hidden",)], "v string").createOrReplaceTempView("secret")
    blocked = [
        "SELECT 'CTE [secret]' AS x, s.v FROM dq_run_log, secret s",
        "SELECT s.v FROM dq_run_log, secret s, (WITH secret AS (SELECT id FROM dq_run_log) SELECT 1 FROM dq_run_log) q",
        "WITH secret AS (SELECT v FROM secret) SELECT v FROM secret",
        "SELECT id FROM dq_run_log WHERE id < (SELECT max(length(v)) FROM (SELECT v FROM secret))",
        "SELECT id FROM dq_run_log WHERE EXISTS (SELECT 1 FROM dq_run_log WHERE 'x' IN (SELECT v FROM `SECRET`))",
        "SELECT sum(id) OVER w FROM dq_run_log WINDOW w AS (PARTITION BY (SELECT max(v) FROM secret))",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')", "SELECT * FROM parquet.`dq_run_log`",
        "SELECT l.v FROM dq_run_log, LATERAL (SELECT v FROM secret) l", "SELECT id FROM dq_run_log UNION SELECT v FROM secret",
    ]
    for sql in blocked:
        assert run_query(spark, sql, ["DQ_RUN_LOG"])[0] == "BLOCKED", sql
    for sql in ("SELECT 'UnresolvedRelation [zzz]' AS x FROM dq_run_log", "SELECT DQ_Run_Log.id FROM dq_run_log, range(2)"):
        assert run_query(spark, sql, ["DQ_RUN_LOG"])[0] == "SUCCESS", sql
    for sql, names in (
        ("WITH secret AS (SELECT id FROM dq_run_log) SELECT * FROM secret", [("dq_run_log",)]),
        ("WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 3) SELECT k FROM n, t", [("t",)]),
        ("WITH a AS (SELECT * FROM t), A2 AS (SELECT * FROM A) SELECT * FROM a2, b.a", [("t",), ("b", "a")]),
        ("SELECT * FROM f(TABLE(t))", [("f()",), ("t",)]),
    ):
        assert relations_read(spark, sql) == names, sql
