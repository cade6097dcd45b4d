"""Hot keys: results stay whole, no pairs are formed, joins can be split."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.operators import delta, grouped_checks
from plumbline.operators import relational_checks as rel
from plumbline.operators.skew import compact_key, keep_left, probe
from plumbline.plans import health


@pytest.fixture
def split_settings(spark):
    """Make small data look large to adaptive execution."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(spark, n=60_000):
    """A third of all rows share key 7."""
    rows = spark.range(0, n, 1, 8)
    return rows.select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), 
        F.md5(F.col("id").cast("string")).alias("v"), "id")


def hot_runs(spark):
    log = hot(spark).selectExpr(
        "CAST(id AS STRING) AS run_id", "CAST(k AS STRING) AS target_table", "id AS failed_checks",
        "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT), 0) AS run_start_time")
    scores = hot(spark).selectExpr("CAST(id AS STRING) AS run_id", "CAST(1 AS DECIMAL(5,2)) AS health_score")
    return health.score_changes(scores, log, F.lit("2024-01-10").cast("timestamp_ntz"))


JOINS = {
    "anti": (lambda s: probe(hot(s), ["k"], hot(s).where("k <> 7"), ["k"], "left_anti"), 20_001),
    "semi": (lambda s: probe(hot(s), ["k"], s.range(1000).select((F.col("id") % 8).alias("k")), ["k"], "left_semi"), 20_005),
    "recon": (lambda s: rel.reconcile(hot(s), "k", "id", hot(s).withColumn("n", F.col("id")), "k", "n", "id"), 59_999),
    "tree": (lambda s: rel.hierarchy_findings(hot(s).select("id", F.col("k").alias("p")), "id", "p"), 40_000),
    "feed": (lambda s: delta.change_feed(hot(s), hot(s).withColumn("v", F.lit("y")), ["k"]), 120_000),
    "rerun": (hot_runs, 4_322),
}


@pytest.mark.parametrize("name", list(JOINS))
def test_hot_keys_are_split(spark, split_settings, name):
    build, rows = JOINS[name]
    joined = build(spark)
    assert len(joined.collect()) == rows
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_a_hot_key_is_reduced_before_sources_are_compared(spark):
    found = rel.differing_values(hot(spark), hot(spark).withColumn("v", F.lit("x")), "k", "v")
    assert found.count() == 40_000 and found.where("k = 7").first().pairs == 20_001 * 20_001


def test_keep_left_cuts_a_hot_key_on_the_right(spark):
    joined = keep_left(spark.range(100).select(F.col("id").alias("k")), hot(spark), ["k"], 1_000)
    assert joined.count() == 20_100 and joined.where("k = 7").count() == 20_001


@pytest.mark.parametrize("share", [1, 3, 1_000_000])
def test_keep_left_is_a_left_join(spark, share):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice([None, 1, 2, 3, 9]), i) for i in range(40)], "k bigint, a bigint")
    right = spark.createDataFrame([(rng.choice([None, 1, 1, 1, 2]), i) for i in range(40)], "k bigint, b bigint")
    expected = Counter(tuple(r) for r in left.join(right, "k", "left").collect())
    assert Counter(tuple(r) for r in keep_left(left, right, ["k"], share).collect()) == expected


def test_compact_keys_are_equal_exactly_when_the_text_is(spark):
    long = "a" * 65
    values = ["", None, "a" * 64, long, long + "b", "b" * 64]
    df = spark.createDataFrame([(v,) for v in values + values], "v string")
    groups = df.groupBy(compact_key("v", df.schema)).count().collect()
    assert len(groups) == len(values) and all(r["count"] == 2 for r in groups)
    assert max(len(r.v or "") for r in groups) == 65


@pytest.mark.parametrize("wide", [True, False])
def test_duplicates_with_nulls_and_long_text(spark, wide):
    rows = [("x" * 4000, 1), ("x" * 4000, 1), (None, 1), (None, 1), (None, 2), ("y", None), ("y", None), ("z", 1)]
    df = spark.createDataFrame(rows, "t string, n bigint")
    found = grouped_checks.duplicate_records(df, ["t", "n"], wide=wide).collect()
    assert sorted((len(r.t or ""), r.n or 0, r.dup_count) for r in found) == [(0, 1, 2), (1, 0, 2), (4000, 1, 2)]


def brute_pairs(a, b):
    return Counter(
        (k, x, y) for k, x in a for m, y in b
        if k is not None and k == m and x is not None and y is not None and x != y
    )


def test_differing_values_count_all_pairs_without_forming_them(spark):
    rng = random.Random(11)
    a = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 1.0, 2.0])) for _ in range(60)] + [(50, 1.0)]
    b = [(rng.choice([1, 2, 3, 5]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(60)] + [(50, 2.0)]
    found = rel.differing_values(
        spark.createDataFrame(a, "k bigint, v double"), spark.createDataFrame(b, "k bigint, v double"), "k", "v").collect()
    pairs = brute_pairs(a, b)
    for key in {k for k, _ in a} | {k for k, _ in b}:
        rows = [r for r in found if r.k == key]
        assert sum(r.pairs for r in rows) == sum(n for (k, _, _), n in pairs.items() if k == key)
        for r in rows:
            values = {x for k, x in a if k == key and x is not None}, {x for k, x in b if k == key and x is not None}
            assert (r.source_a_val, r.source_a_max, r.source_b_val, r.source_b_max) == (
                min(values[0]), max(values[0]), min(values[1]), max(values[1]))
    assert [(r.source_a_val, r.source_b_val, r.pairs) for r in found if r.k == 50] == [(1.0, 2.0, 1)]


def test_hierarchy_counts_repeated_rows(spark):
    rows = [(1, 2)] * 300 + [(2, 1)] * 200 + [(3, 3), (4, 99), (4, 99), (5, None)]
    found = rel.hierarchy_findings(spark.createDataFrame(rows, "id bigint, p bigint"), "id", "p").collect()
    assert sorted((r.record_id, r.failed_value, r.findings) for r in found) == [
        (1, "CIRCULAR", 60_000), (2, "CIRCULAR", 60_000), (3, "CIRCULAR", 1), (4, "ORPHAN", 2)]


def test_reconcile_folds_equal_target_rows(spark):
    source = spark.createDataFrame([("d1", 5.0), ("d1", 6.0), ("d2", 1.0), (None, 9.0)], "d string, a double")
    target = spark.createDataFrame([("d1", 2, 12.0)] * 1000 + [("d1", 2, 11.0), ("d2", 1, None), ("d3", 1, 1.0)],
                                   "day string, n bigint, total double")
    found = rel.reconcile(source, "d", "a", target, "day", "n", "total").collect()
    assert [(r.record_id, r.src_count, r.tgt_amount, r.matches) for r in found] == [("d1", 2, 12.0, 1000)]


def test_repeated_tuples_agree_with_their_counts(spark):
    rows = [("a", 1, "I"), ("a", 1, "X"), ("a", 1, "U"), ("b", 1, "I"), ("b", 1, "X"), (None, 1, "I"), (None, 1, "I")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, k string, s bigint, op string")
    rows = rel.repeated_tuples(df, ["k", "s"], "id", "op", "op <> 'X'", "op <> 'U'").collect()
    counts = rel.repeated_tuple_counts(df, ["k", "s"], "op <> 'X'", "op <> 'U'").collect()
    assert sorted(r.record_id for r in rows) == [0, 1]
    assert [(r.k, r.n) for r in counts] == [("a", 2)]
