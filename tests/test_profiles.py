"""Profiles, distributions and schema drift."""

import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline.operators import schema_checks
from plumbline.plans import profiling, reports
from plumbline.workloads import WORKLOADS
from tests import duck

NOW = dt.datetime(2024, 1, 31)


def table(spark):
    long = "long text " * 60
    rows = [(1, "a", 1.5, True, long), (2, "b", -0.0, None, long), (2, "a", 0.0, True, long + "!"), (None, None, None, False, "s")]
    return spark.createDataFrame(rows, "id int, c string, x double, f boolean, body string")


def test_column_profiles(spark):
    found = {r.column_name: r for r in profiling.column_profiles(table(spark)).collect()}
    assert (found["id"].distinct_count, found["id"].mean, found["id"].median, found["id"].null_pct) == (2, 1.6667, 2.0, 25.0)
    assert (found["x"].distinct_count, found["x"].min_value, found["x"].max_value) == (2, "0.0", "1.5")
    assert [(v.value, v["count"]) for v in found["c"].top_values] == [("a", 2), ("b", 1)]
    assert found["c"].mean is None and found["c"].median is None
    assert [(len(v.value), v["count"]) for v in found["body"].top_values] == [(600, 2), (601, 1), (1, 1)]
    assert found["body"].distinct_count == 3 and found["body"].max_value == "s"


def test_text_extremes_are_lexicographic(spark):
    df = spark.createDataFrame([(9,), (10,)], "n int")
    row = profiling.column_profiles(df).first()
    assert (row.min_value, row.max_value) == ("10", "9")
    assert (row.typed_min, row.typed_max) == ("9", "10")


def test_unsupported_types_are_noted(spark):
    df = spark.range(2).select("id", F.create_map(F.lit("a"), F.lit(1)).alias("m"), F.array("id").alias("l"))
    found = {r.column_name: r for r in profiling.column_profiles(df).collect()}
    assert found["m"].pattern_summary.startswith("ERROR") and found["l"].pattern_summary.startswith("ERROR")
    assert found["id"].distinct_count == 2 and found["id"].pattern_summary is None


def test_empty_table(spark):
    found = {r.column_name: r for r in profiling.column_profiles(table(spark).limit(0)).collect()}
    assert len(found) == 5
    assert all(r.row_count == 0 and r.null_pct is None and r.distinct_count == 0 and r.top_values is None
               for r in found.values())
    assert profiling.distributions(table(spark).limit(0)).count() == 0


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "gfedcbaa"], "c string")
    top = profiling.top_values(df, profiling.value_counts(df, ["c"])).first().top_values
    assert [v.value for v in top] == ["a", "b", "c", "d", "e"]


def test_distributions(spark):
    found = {(r.column_name, r.value_or_bucket): (r.record_count, r.percentage)
             for r in profiling.distributions(table(spark)).collect()}
    assert found["c", "a"] == (2, 50.0) and found["c", "<NULL>"] == (1, 25.0)
    assert found["f", "true"] == (2, 50.0) and found["f", "<NULL>"] == (1, 25.0)
    assert ("body", "long text " * 60) in found
    many = spark.range(21).select(F.col("id").cast("string").alias("c"))
    assert profiling.distributions(many).count() == 0
    assert profiling.distributions(many.where("id < 20")).count() == 20


def test_one_shuffle_per_type_family(spark):
    df = spark.range(5).select(*[F.col("id").alias(f"l{i}") for i in range(30)], *[
        F.col("id").cast("string").alias(f"s{i}") for i in range(30)])
    plan = profiling.value_counts(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_most_frequent_values_are_limited_before_the_shuffle(spark):
    df = table(spark)
    plan = profiling.top_values(df, profiling.value_counts(df, df.columns))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_approximate_profiles_shuffle_no_values(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    sketch = profiling.approximate_profiles(orders)
    assert "Exchange hashpartitioning" not in sketch._jdf.queryExecution().executedPlan().toString()
    exact = {r.column_name: r for r in profiling.column_profiles(orders).collect()}
    for r in sketch.collect():
        assert r.null_count == exact[r.column_name].null_count
        assert r.distinct_count == pytest.approx(exact[r.column_name].distinct_count, rel=0.15)
    status = next(r for r in sketch.collect() if r.column_name == "o_orderstatus")
    assert {v.value for v in status.top_values} == {"F", "O", "P"}


def test_receipt(spark):
    profile = profiling.table_profile(table(spark), "t", NOW)
    receipt = profiling.profile_receipt(profile).first().receipt
    assert '"rows":4' in receipt and '"columns":5' in receipt and '"status":"COMPLETED"' in receipt


def test_report_uses_the_newest_profile(spark):
    df = table(spark).select("id", "c")
    old, new = dt.datetime(2024, 1, 1), NOW
    tables = profiling.table_profile(df.limit(1), "t", old).unionByName(profiling.table_profile(df, "t", new))
    columns = profiling.located(profiling.column_profiles(df.limit(1)), "t", old).unionByName(
        profiling.located(profiling.column_profiles(df), "t", new))
    values = profiling.located(profiling.distributions(df), "t", new, "snapshot_at")
    assert reports.profile_reports(tables, columns, values).first().report == (
        "Profile of main.public.t\ntaken 2024-01-31 00:00:00\n4 rows in 2 columns\n\nColumns\n"
        "- c (string): nulls=1 (25.0%), distinct=2, min=a, max=b\n"
        "- id (integer): nulls=1 (25.0%), distinct=2, min=1, max=2, mean=1.6667, median=2.0\n\n"
        "Values\nColumn c:\n  a: 2 rows (50.0%)\n  <NULL>: 1 rows (25.0%)\n  b: 1 rows (25.0%)\n")


def columns_of(spark, ddl, name="t"):
    return schema_checks.schema_frame(spark, spark.createDataFrame([], ddl).schema, name)


def test_schema_frame(spark):
    found = columns_of(spark, "a bigint, b decimal(10,2)").orderBy("ordinal_position").collect()
    assert [(r.column_name, r.ordinal_position, r.data_type, r.numeric_precision, r.numeric_scale) for r in found] == [
        ("a", 1, "long", None, None), ("b", 2, "decimal", 10, 2)]


def test_drift(spark):
    first = schema_checks.schema_snapshot(columns_of(spark, "a int, b string, c int, gone string"), None, dt.datetime(2024, 1, 1))
    second = schema_checks.schema_snapshot(columns_of(spark, "a int, b string, c int, d decimal(5,1)"), first, dt.datetime(2024, 1, 2))
    snapshots = first.unionByName(second)
    assert sorted(r.snapshot_id for r in snapshots.collect()) == list(range(1, 9))
    now = columns_of(spark, "a int, b bigint, c int, d decimal(9,3), e string")
    summary = schema_checks.drift_summary(now, snapshots).first()
    assert (summary.status, summary.drift_count, summary.drift_list) == ("DRIFT_DETECTED", 2, "ADDED:e, TYPE_CHANGED:b")
    every = sorted(tuple(r) for r in schema_checks.changed_columns(now, snapshots, "t").collect())
    assert every == [("t", "e", "ADDED"), ("t", "gone", "REMOVED")]
    same = columns_of(spark, "a int, b string, c int, d decimal(5,1)")
    assert schema_checks.drift_summary(same, snapshots).first().status == "NO_DRIFT"
    other = columns_of(spark, "a int", "u")
    assert schema_checks.drift_summary(other, snapshots).first().status == "NO_BASELINE"


def test_check_reports_removed_columns_once_per_snapshot(spark):
    base = columns_of(spark, "a int, gone int")
    first = schema_checks.schema_snapshot(base, None, dt.datetime(2024, 1, 1))
    snapshots = first.unionByName(schema_checks.schema_snapshot(base, first, dt.datetime(2024, 1, 2)))
    found = schema_checks.changed_columns(columns_of(spark, "a int"), snapshots, "t").collect()
    assert [(r.record_id, r.failed_value) for r in found] == [("gone", "REMOVED")] * 2


def test_changed_columns_read_each_side_once_and_keep_every_copy(spark, sf_dir):
    plan = WORKLOADS["chk17_drift"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 2 and "Join" not in plan
    names = "table_name string, column_name string"
    now = spark.createDataFrame([("t", "new"), ("t", "new"), ("t", "kept"), (None, "x"), ("t", None)], names)
    old = spark.createDataFrame([("t", "kept")] * 3 + [("t", "gone")] * 2001 + [(None, "x")] * 2, names)
    found = Counter(tuple(r) for r in schema_checks.changed_columns(now, old).collect())
    assert found == {("t", "new", "ADDED"): 2, (None, "x", "ADDED"): 1, ("t", None, "ADDED"): 1,
                     ("t", "gone", "REMOVED"): 2001, (None, "x", "REMOVED"): 2}
    assert Counter(r.record_id for r in schema_checks.changed_columns(now, old, "t").collect()) == {
        "new": 2, None: 1, "gone": 2001}


def test_renames(spark):
    before = schema_checks.schema_snapshot(columns_of(spark, "a int, b string, c int"), None, dt.datetime(2024, 1, 1))
    found = schema_checks.renamed_columns(columns_of(spark, "a int, label string, c2 string"), before).collect()
    assert [(r.old_name, r.new_name) for r in found] == [("b", "label")]


def test_extremes_as_text_tell_a_negative_zero(spark, tmp_path):
    """The registered queries against their SQL, on customers of whom one has a balance of negative zero."""
    rows = [(k, f"c{k}", k % 3, v, "M") for k, v in enumerate([-0.0, -0.01, 3.5, 0.0])]
    df = spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    df.write.parquet(f"{tmp_path}/customer.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    for name in ("profile_columns", "q05_columns"):
        found = duck.spark_rows(WORKLOADS[name](spark, str(tmp_path)))
        assert found == duck.sql_rows(connection, WORKLOADS[name].sql)


def test_snapshot_ids_of_many_tables_pass_no_table_through_the_driver(spark, monkeypatch):
    """5,000 tables of one to three columns: ids follow the order, and only a few counts are fetched."""
    rows = spark.range(5_000).select(
        F.concat(F.lit("t"), F.col("id") * 7919 % 5000).alias("table_name"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("id") % 3 + 1)).alias("ordinal_position"))
    listing = rows.select(
        F.lit("c").alias("table_catalog"), F.lit("s").alias("table_schema"), "table_name",
        F.concat(F.lit("c"), "ordinal_position").alias("column_name"), "ordinal_position", F.lit("long").alias("data_type"),
        *[F.lit(None).cast("bigint").alias(c) for c in ("character_maximum_length", "numeric_precision", "numeric_scale")],
        F.lit("YES").alias("is_nullable"))
    fetched = []
    collect = type(listing).collect
    with monkeypatch.context() as patch:
        patch.setattr(type(listing), "collect", lambda df: (lambda got: (fetched.append(len(got)), got)[1])(collect(df)))
        found = schema_checks.schema_snapshot(listing, None, dt.datetime(2024, 1, 1))
    assert sum(fetched) < 500
    ids = [r.snapshot_id for r in found.orderBy("table_name", "ordinal_position").collect()]
    assert ids == list(range(1, len(ids) + 1)) and len(ids) == listing.count()
