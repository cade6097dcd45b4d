"""Tasks that do not get more as a table grows: files of a stream, days of a write."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from plumbline.plans import profiling
from plumbline.session import setting
from plumbline.sources.store import ResultStore
from plumbline.sources.tables import parquet_tables
from plumbline.workloads import WORKLOADS, reply_level


def test_days_are_written_side_by_side_and_not_sorted(spark, tmp_path, monkeypatch):
    key, seen, plain = "spark.sql.maxConcurrentOutputFileWriters", {}, DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        seen[path.rsplit("/", 1)[-1]] = int(spark.conf.get(key))
        return plain(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    before = spark.conf.get(key)
    store = ResultStore(spark, str(tmp_path / "store"))
    day = F.timestamp_add("DAY", F.col("id").cast("int") % 40, F.lit(dt.datetime(2024, 1, 1))).cast("timestamp_ntz")
    store.append("check_results", spark.range(400).select(
        F.concat(F.lit("R"), "id").alias("run_id"), F.col("id").alias("check_id"), day.alias("created_at")))
    assert seen["rows"] >= 8 and seen["changes"] >= 8
    assert spark.conf.get(key) == before
    rows = store.read("check_results").groupBy("run_day").count().collect()
    assert {r["count"] for r in rows} == {10} and len(rows) == 40


def test_streams_have_files_of_bounded_size_and_three_batches(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(reply_level, "ROWS_PER_FILE", 500)
    tables = parquet_tables(spark, sf_dir)
    stream = reply_level.stream_of(tables, "lineitem")
    seen = []
    stream.writeStream.foreachBatch(lambda batch, k: seen.append(
        (batch.select(F.input_file_name()).distinct().count(), batch.count()))).trigger(availableNow=True).start().awaitTermination()
    rows = tables["lineitem"].count()
    assert len(seen) == 3 and sum(n for _, n in seen) == rows
    assert all(n / files < 750 for files, n in seen)


def shuffled_rows(node):
    """Rows written by each shuffle of a plan that was run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled_rows(node.executedPlan())
    if name.endswith("QueryStage"):
        return shuffled_rows(node.plan())
    own = [node.metrics().apply("shuffleRecordsWritten").value()] if name == "Exchange" else []
    children = node.children()
    return own + [n for i in range(children.size()) for n in shuffled_rows(children.apply(i))]


@pytest.fixture
def no_broadcast(spark):
    """Make small data look large to the optimizer."""
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", -1), setting(
            spark, "spark.sql.adaptive.autoBroadcastJoinThreshold", -1):
        yield


def test_values_of_columns_with_many_values_are_not_joined(spark, no_broadcast):
    df = spark.range(0, 5000, 1, 2).select(
        "id", F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    found = profiling.distributions(df, counts=profiling.value_counts_of(df))
    rows = {(r.column_name, r.value_or_bucket): r.record_count for r in found.collect()}
    assert rows == {("few", "0"): 1667, ("few", "1"): 1667, ("few", "2"): 1666}
    written = shuffled_rows(found._jdf.queryExecution().executedPlan())
    assert written and max(written) < 200


def looked_up(node):
    """Columns of the left side of each left join of an optimized plan."""
    children = node.children()
    own = []
    if node.nodeName() == "Join" and node.joinType().toString() == "LeftOuter":
        output = node.left().output()
        own = [{output.apply(i).name() for i in range(output.size())}]
    return own + [c for i in range(children.size()) for c in looked_up(children.apply(i))]


@pytest.mark.parametrize("name,joins", [("remediation_report", 3), ("failure_report", 2)])
def test_results_of_a_report_are_shuffled_as_text(spark, sf_dir, name, joins):
    sides = looked_up(WORKLOADS[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan())
    shown = {"result_id", "run_id", "check_id", "target_table", "target_column", "outcome_text", "target_database",
             "target_schema", "params_text"}
    assert len(sides) == joins and all(side <= shown for side in sides)
