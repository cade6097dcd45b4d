"""Columns by content, and profiles merged from parts."""

import datetime as dt

from pyspark.sql import functions as F

from plumbline.operators import content
from plumbline.plans import carried_profiles, profiling
from plumbline.session import scratch_path
from plumbline.sources.store import ResultStore

AS_OF = dt.datetime(2024, 1, 31)


def test_sketches_hold_the_smallest_hashes(spark):
    df = spark.range(20_000).selectExpr("id", "id % 7 AS few", "CAST(NULL AS STRING) AS none", "concat('x', id % 3000) AS t")
    found = {r.column_name: r for r in content.column_sketches(df, 64).collect()}
    for name in df.columns:
        hashes = df.select(F.xxhash64(F.col(name).cast("string")).alias("h")).where(F.col(name).isNotNull()).distinct()
        assert found[name].sketch == [r.h for r in hashes.orderBy("h").limit(64).collect()]
    assert [found[c].position for c in df.columns] == [1, 2, 3, 4]


def test_renamed_swapped_and_new_columns(spark):
    old = spark.range(3000).selectExpr("id AS a", "id + 10000 AS b", "concat('t', id) AS c", "id % 5 AS d", "uuid() AS gone")
    new = spark.range(200, 3000).selectExpr("id + 10000 AS a", "id AS b", "id % 5 AS d", "concat('n', id) AS fresh", "concat('t', id) AS e")
    rows = content.renamed_by_content(content.column_sketches(old), content.column_sketches(new)).collect()
    assert {(r.old_name, r.new_name, r.kind) for r in rows} == {("a", "b", "SWAPPED"), ("b", "a", "SWAPPED"), ("c", "e", "RENAMED")}
    assert all(0.8 < r.similarity <= 1 for r in rows)


def test_parts_add_up_and_are_replaced(spark):
    df = spark.range(1000).selectExpr(
        "id", "CASE WHEN id % 10 > 0 THEN id / 4 END AS v", "concat('k', id % 30) AS t", "CAST(NULL AS INT) AS n", "id % 4 AS part")
    store = ResultStore(spark, scratch_path(spark, "store"))
    carried_profiles.carry_on(store, df.where("part <> 2 OR id < 100"), F.col("part"), "t", AS_OF)
    carried_profiles.carry_on(store, df.where("part = 2"), F.col("part"), "t", AS_OF + dt.timedelta(days=1))
    carried_profiles.carry_on(store, df.where("part = 2"), F.col("part"), "other", AS_OF)
    merged = {r.column_name: r for r in carried_profiles.carried_profile(store, df.schema, "t").collect()}
    whole = {r.column_name: r for r in profiling.column_profiles(df).collect()}
    exact = ("data_type", "row_count", "null_count", "null_pct", "min_value", "max_value", "typed_min", "typed_max", "mean")
    for name, r in whole.items():
        assert [merged[name][c] for c in exact] == [r[c] for c in exact]
        assert abs(merged[name].distinct_count - r.distinct_count) <= 4 * carried_profiles.DISTINCT_ERROR * r.distinct_count
        if r.median is not None:
            # The sketch's error is one of rank; its median is a value of the column, never one in between.
            m, filled = merged[name].median, r.row_count - r.null_count
            assert df.where(F.col(name) < m).count() <= (0.5 + 2 * carried_profiles.RANK_ERROR) * filled
            assert df.where(F.col(name) <= m).count() >= (0.5 - 2 * carried_profiles.RANK_ERROR) * filled
    assert merged["n"].median is None and merged["n"].distinct_count == 0
