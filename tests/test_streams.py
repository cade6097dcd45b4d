"""Streams over files in several batches, restarts included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.config.specs import spec
from plumbline.operators.schema_checks import schema_frame, schema_snapshot
from plumbline.session import scratch_path
from plumbline.sources.store import ResultStore
from plumbline.streaming import checks, feeds, group_checks
from plumbline.workloads.reply_level import EVENT_SPECS

AS_OF = dt.datetime(2024, 1, 31)


def events_in_parts(spark, sf_dir, parts=3):
    path = scratch_path(spark, "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for i in range(parts):
        events.where(F.col("event_id") % parts == i).coalesce(1).write.mode("append").parquet(path)
    return events, path


def read_stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_batches_add_up_to_the_whole(spark, sf_dir):
    events, path = events_in_parts(spark, sf_dir)
    out = scratch_path(spark, "out")
    for _ in range(2):
        stream = read_stream(spark, events.schema, path)
        checks.check_batches(spark, stream, "events", EVENT_SPECS, AS_OF, f"{out}/rows", f"{out}/state").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.select("batch_id").distinct().count() == 3
    counts = {r.check_id: (r.n, r.total) for r in rows.groupBy("check_id").agg(
        F.sum("failure_count").alias("n"), F.sum("total_rows").alias("total")).collect()}
    total = events.count()
    assert counts == {
        9: (events.where("event_type NOT IN ('view','click','signup')").count(), total),
        6: (events.where("value < 1 OR value > 30").count(), total),
        12: (events.where("datediff(timestamp_ntz'2024-01-31 00:00:00', ts) > 20").count(), total),
    }


def test_new_files_are_picked_up_once(spark, sf_dir):
    events, path = events_in_parts(spark, sf_dir, 2)
    out = scratch_path(spark, "out")

    def drain():
        stream = read_stream(spark, events.schema, path)
        feeds.write_batches(stream, lambda b: b.select("event_id"), f"{out}/rows", f"{out}/state").awaitTermination()
        return spark.read.parquet(f"{out}/rows").count()

    assert drain() == events.count()
    events.limit(10).coalesce(1).write.mode("append").parquet(path)
    assert drain() == events.count() + 10


def test_group_checks_are_refused(spark, sf_dir):
    events, path = events_in_parts(spark, sf_dir, 1)
    stream = read_stream(spark, events.schema, path)
    with pytest.raises(ValueError, match="only row checks"):
        checks.check_batches(spark, stream, "events", [spec(2, "events", "event_id")], AS_OF, "x", "y")


def test_feed_of_stored_results(spark):
    store = ResultStore(spark, scratch_path(spark, "feed"))
    names = schemas.CHECK_RESULTS.fieldNames()

    def results(run, *states):
        rows = [dict(run_id=run, check_id=i, check_status=s, created_at=AS_OF) for i, s in enumerate(states)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.CHECK_RESULTS)

    out = scratch_path(spark, "out")
    store.append("check_results", results("a", "PASS", "FAIL"))
    for extra in (None, results("b", "WARNING", "ERROR", "PASS")):
        if extra is not None:
            store.append("check_results", extra)
        feeds.write_batches(store.stream("check_results", 1), feeds.result_feed, f"{out}/rows", f"{out}/state").awaitTermination()
    fed = spark.read.parquet(f"{out}/rows").collect()
    assert sorted((r.run_id, r.check_status) for r in fed) == [("a", "FAIL"), ("b", "ERROR"), ("b", "WARNING")]


def test_feed_of_schema_snapshots(spark):
    store = ResultStore(spark, scratch_path(spark, "feed"))
    before = spark.createDataFrame([], "a int, b string").schema
    store.append("schema_snapshots", schema_snapshot(schema_frame(spark, before, "t"), None, AS_OF))
    now = schema_frame(spark, spark.createDataFrame([], "a bigint, c string").schema, "t")
    out = scratch_path(spark, "out")
    feeds.write_batches(store.stream("schema_snapshots"), feeds.drift_feed(
        now, lambda: store.read("schema_snapshots")), f"{out}/rows", f"{out}/state").awaitTermination()
    row = spark.read.parquet(f"{out}/rows").first()
    assert (row.status, row.drift_list) == ("DRIFT_DETECTED", "ADDED:c, REMOVED:b, TYPE_CHANGED:a")


def test_running_status_counts(spark):
    store = ResultStore(spark, scratch_path(spark, "feed"))
    names = schemas.REMEDIATION_AUDIT.fieldNames()
    for i, states in enumerate([["SUCCESS", "FAILED"], ["SUCCESS"]]):
        rows = [dict(audit_id=f"{i}{j}", analysis_id="x", status=s, executed_at=AS_OF) for j, s in enumerate(states)]
        store.append("remediation_audit", spark.createDataFrame(
            [tuple(r.get(n) for n in names) for r in rows], schemas.REMEDIATION_AUDIT).coalesce(1))
    out = scratch_path(spark, "out")
    counts = feeds.audit_status_counts(store.stream("remediation_audit", 1))
    feeds.write_batches(counts, lambda b: b, f"{out}/rows", f"{out}/state", "complete").awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    last = rows.where(F.col("batch_id") == rows.agg(F.max("batch_id")).first()[0])
    assert {r.status: r.executions for r in last.collect()} == {"SUCCESS": 2, "FAILED": 1}


def arriving(spark, *batches):
    """A folder to which each batch is added by itself, and the stream that reads a file at a time."""
    path = scratch_path(spark, "arriving")
    for rows in batches:
        spark.createDataFrame(rows, "k string, at timestamp_ntz, v int").coalesce(1).write.mode("append").parquet(path)
    return read_stream(spark, spark.read.parquet(path).schema, path)


def hour(day, at=0):
    return dt.datetime(2024, 1, day, at)


def followed(stream, specs, span="1 day", delay="1 day"):
    out = scratch_path(stream.sparkSession, "groups")
    query = group_checks.check_groups(stream, specs, "at", span, delay, f"{out}/rows", f"{out}/state")
    query.awaitTermination()
    return query, stream.sparkSession.read.parquet(f"{out}/rows")


def test_groups_across_batches_and_windows(spark):
    """A key repeated within the span is found wherever the windows lie, one repeated much later is not."""
    rows = [("a", hour(1, 23), 1)], [("a", hour(2, 1), 2), ("b", hour(2, 5), 1)], [("b", hour(20), 1), (None, hour(20), 1), (None, hour(20, 2), 1)]
    specs = [spec(2, "t", "k")]
    query, findings = followed(arriving(spark, *rows), specs)
    standing = group_checks.standing(findings).collect()
    assert {(r.group_key, r.occurrences) for r in standing} == {('{"k":"a"}', 2), ('{"k":null}', 2)}
    results = group_checks.group_results(findings, specs).collect()
    assert [(r.check_id, r.failure_count, r.check_status) for r in results] == [(2, 2, "FAIL")]
    assert group_checks.late_rows(query) == 0


def test_state_leaves_after_the_watermark_and_late_rows_are_counted(spark):
    days = [[(f"k{d}-{i}", hour(d), 1) for i in range(50)] for d in range(1, 29, 3)]
    late = [("k1-0", hour(1), 1), ("k1-0", hour(1), 1)]
    query, findings = followed(arriving(spark, *days, late), [spec(2, "t", "k")])
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(states) <= 300 and states[-1] <= 300 < 2 * 50 * len(days)
    assert findings.count() == 0 and group_checks.late_rows(query) >= 2


def test_group_checks_agree_with_the_batch_checks(spark, sf_dir):
    """With a span as long as the table, a stream finds what the whole table shows."""
    from plumbline.operators import grouped_checks, relational_checks

    events, path = events_in_parts(spark, sf_dir)
    specs = [spec(2, "events", "user_id"), spec(3, "events", columns="user_id,event_type"),
             spec(25, "events", cdc_op_column="event_type", record_id="event_id", duplicate_keys="user_id",
                  group_filter="value > 30", row_filter="event_type = 'click'")]
    out = scratch_path(spark, "groups")
    group_checks.check_groups(read_stream(spark, events.schema, path), specs, "ts", "4000 days", "4000 days", f"{out}/rows",
                              f"{out}/state").awaitTermination()
    found = {r.check_id: r.failure_count for r in group_checks.group_results(spark.read.parquet(f"{out}/rows"), specs).collect()}
    assert found == {
        2: grouped_checks.repeated_keys(events, "user_id").count(),
        3: grouped_checks.duplicate_records(events, ["user_id", "event_type"]).count(),
        25: relational_checks.repeated_tuple_counts(events, ["user_id"], "value > 30", "event_type = 'click'").agg(F.sum("n")).first()[0]}


def test_other_checks_are_no_group_checks(spark, sf_dir):
    events, path = events_in_parts(spark, sf_dir, 1)
    with pytest.raises(ValueError, match="no group checks"):
        group_checks.check_groups(
            read_stream(spark, events.schema, path), [spec(1, "events", "value")], "ts", "1 day", "1 day", "x", "y")
