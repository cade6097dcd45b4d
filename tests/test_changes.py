"""Table versions, repairs and stores."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.operators import delta, repair
from plumbline.session import scratch_path
from plumbline.sources.store import ResultStore
from plumbline.streaming import feeds

DDL = "k bigint, v string, n double"


def versions(seed):
    rng = random.Random(seed)
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice(["a", "b", None]), rng.choice([None, 1.0])) for _ in range(40)]
    return rows[:30], rows[8:]


@pytest.mark.parametrize("seed", range(4))
def test_changes_turn_old_into_new(spark, seed):
    old, new = versions(seed)
    changes = delta.net_changes(spark.createDataFrame(old, DDL), spark.createDataFrame(new, DDL)).collect()
    result = Counter(old)
    for r in changes:
        result[r.k, r.v, r.n] += r.row_count if r.action == "INSERT" else -r.row_count
    assert +result == Counter(new) and min(result.values()) >= 0


def test_equal_versions_have_no_changes(spark):
    old, _ = versions(1)
    df = spark.createDataFrame(old, DDL)
    assert delta.change_feed(df, df.repartition(5), ["k"]).count() == 0


def test_swapping_versions_swaps_actions(spark):
    old, new = (spark.createDataFrame(r, DDL) for r in versions(2))
    swap = {"INSERT": "DELETE", "DELETE": "INSERT"}
    there = {tuple(r) for r in delta.change_feed(old, new, ["k"]).collect()}
    back = {(r.k, r.v, r.n, swap[r.action], r.is_update, r.row_count) for r in delta.change_feed(new, old, ["k"]).collect()}
    assert there == back


def test_updates_are_keys_with_both(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (None, "c", 1.0)], DDL)
    new = spark.createDataFrame([(1, "a", 2.0), (3, "d", 1.0), (None, "e", 1.0)], DDL)
    feed = {(r.k, r.action): r.is_update for r in delta.change_feed(old, new, ["k"]).collect()}
    assert feed == {(1, "DELETE"): True, (1, "INSERT"): True, (2, "DELETE"): False, (3, "INSERT"): False,
                    (None, "DELETE"): True, (None, "INSERT"): True}
    summary = {r.change_type: r.row_count for r in delta.change_summary(old, new, ["k"]).collect()}
    assert summary == {"UPDATE": 2, "DELETE": 1, "INSERT": 1}


def test_update_sees_old_values_and_skips_unknown(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, None)], DDL)
    fixed = repair.update_where(df, F.col("n") > 0, {"v": F.concat("v", F.lit("!")), "n": F.col("n") + F.length("v")})
    assert {tuple(r) for r in fixed.collect()} == {(1, "a!", 2.0), (2, None, None)}


def test_observed_update_counts_changed_rows(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", -1.0), (3, "c", None)], DDL)
    fixed, seen = repair.observed_update(df, F.col("n") < 0, {"n": F.lit(0.0)})
    fixed.write.format("noop").mode("overwrite").save()
    assert seen.get == {"changed_rows": 1}


def test_merge(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0), (None, "d", 1.0)], DDL)
    rows = spark.createDataFrame([(1, "x"), (5, "y"), (None, "z"), (None, "w")], "k bigint, v string")
    merged = Counter(tuple(r) for r in repair.merge_rows(df, rows, ["k"]).collect())
    assert merged == Counter([(1, "x", None), (2, "c", 1.0), (None, "d", 1.0), (5, "y", None), (None, "z", None),
                              (None, "w", None)])


def test_merge_refuses_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a", 1.0)], DDL)
    rows = spark.createDataFrame([(4, "x", 1.0), (4, "y", 1.0)], DDL)
    with pytest.raises(Exception, match="input repeats key"):
        repair.merge_rows(df, rows, ["k"]).collect()


def test_replace_by_key_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "c", 1.0)], DDL)
    rows = spark.createDataFrame([(1, "x", 9.0)], DDL)
    once = repair.replace_by_key(df, rows, ["k"])
    twice = repair.replace_by_key(once, rows, ["k"])
    assert Counter(map(tuple, once.collect())) == Counter(map(tuple, twice.collect())) == Counter(
        [(1, "x", 9.0), (2, "c", 1.0)])


def scores(spark, *rows):
    full = [(f"s{run}", run, "t", Decimal(score), 1, 1, 0, 0, 0, 0, 0, moment) for run, score, moment in rows]
    return spark.createDataFrame(full, schemas.HEALTH_SCORES)


def test_store_replaces_only_the_given_runs(spark):
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    day = dt.datetime(2024, 1, 1, 5)
    store.append("health_scores", scores(spark, ("r1", "10.00", day), ("r2", "20.00", day)))
    for _ in range(2):
        store.replace_runs("health_scores", scores(spark, ("r1", "15.00", day)))
        found = {r.run_id: r.health_score for r in store.read("health_scores").collect()}
        assert found == {"r1": Decimal("15.00"), "r2": Decimal("20.00")}
    assert store.read("health_scores").where("run_day = '2024-01-02'").count() == 0
    store.clear("health_scores")
    assert store.read("health_scores").count() == 0


def test_store_reads_older_files_without_new_columns(spark):
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    day = dt.datetime(2024, 1, 1)
    store.append("health_scores", scores(spark, ("r1", "10.00", day)).drop("low_failures"))
    store.append("health_scores", scores(spark, ("r2", "10.00", day)))
    assert {r.run_id: r.low_failures for r in store.read("health_scores").collect()} == {"r1": None, "r2": 0}


def test_add_column_and_replace_values(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], DDL)
    assert repair.add_column(df, "code", "string").dtypes[-1] == ("code", "string")
    fixed = repair.replace_values(df, spark.createDataFrame([(2, "z")], "k bigint, v string"), "k", "v")
    assert {tuple(r) for r in fixed.collect()} == {(1, "a", 1.0), (2, "z", 2.0)}
    twice = spark.createDataFrame([(2, "z"), (2, "y")], "k bigint, v string")
    with pytest.raises(Exception, match="input repeats key"):
        repair.replace_values(df, twice, "k", "v").collect()


def results(spark, run, *states, moment=dt.datetime(2024, 1, 1, 5)):
    rows = [dict(run_id=run, check_id=i, check_status=s, created_at=moment) for i, s in enumerate(states)]
    names = schemas.CHECK_RESULTS.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schemas.CHECK_RESULTS)


def states(df):
    return sorted((r.run_id, r.check_id, r.check_status) for r in df.collect())


def test_a_followed_store_tells_each_change_once(spark):
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    out = scratch_path(spark, "out")

    def drained(k):
        feeds.write_batches(
            store.stream("check_results"), lambda b: b, f"{out}/rows/k={k}", f"{out}/state").awaitTermination()
        try:
            rows = spark.read.parquet(f"{out}/rows/k={k}").collect()
        except AnalysisException:
            return []
        return sorted((r.run_id, r.check_id, r.check_status, r.change_type) for r in rows)

    store.replace_runs("check_results", results(spark, "a", "PASS", "FAIL"))
    assert drained(1) == [("a", 0, "PASS", "INSERT"), ("a", 1, "FAIL", "INSERT")]
    store.replace_runs("check_results", results(spark, "b", "WARNING"))
    assert drained(2) == [("b", 0, "WARNING", "INSERT")]
    store.replace_runs("check_results", results(spark, "a", "PASS", "PASS"))
    assert drained(3) == [("a", 1, "FAIL", "UPDATE_BEFORE"), ("a", 1, "PASS", "UPDATE_AFTER")]
    store.replace_runs("check_results", results(spark, "a", "PASS", "PASS"))
    assert drained(4) == []
    store.clear("check_results")
    assert drained(5) == [("a", 0, "PASS", "DELETE"), ("a", 1, "PASS", "DELETE"), ("b", 0, "WARNING", "DELETE")]


def test_two_writers_keep_each_other_s_rows(spark, monkeypatch):
    """Both read the store before either commits; each replaces its own unit."""
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    store.append("check_results", results(spark, "a", "PASS").unionByName(results(spark, "b", "PASS")))
    publish = ResultStore._publish

    def interrupted(self, table, write_id, version):
        monkeypatch.setattr(ResultStore, "_publish", publish)
        ResultStore(spark, self.root).replace_runs(table, results(spark, "b", "FAIL", "FAIL"))
        publish(self, table, write_id, version)

    monkeypatch.setattr(ResultStore, "_publish", interrupted)
    store.replace_runs("check_results", results(spark, "a", "WARNING"))
    assert states(store.read("check_results")) == [("a", 0, "WARNING"), ("b", 0, "FAIL"), ("b", 1, "FAIL")]
    kinds = sorted((r.run_id, r.check_id, r.change_type) for r in store.changes("check_results").collect())
    assert kinds == [
        ("a", 0, "INSERT"), ("a", 0, "UPDATE_AFTER"), ("a", 0, "UPDATE_BEFORE"),
        ("b", 0, "INSERT"), ("b", 0, "UPDATE_AFTER"), ("b", 0, "UPDATE_BEFORE"), ("b", 1, "INSERT")]


def test_failed_writes_are_unseen_and_lost_changes_recovered(spark, monkeypatch):
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    store.append("check_results", results(spark, "a", "PASS"))
    publish, failing = ResultStore._publish, lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    monkeypatch.setattr(ResultStore, "_publish", failing)
    with pytest.raises(RuntimeError):
        store.replace_runs("check_results", results(spark, "a", "FAIL"))
    monkeypatch.setattr(ResultStore, "_publish", publish)
    assert states(store.read("check_results")) == [("a", 0, "FAIL")]
    assert (store.changes("check_results").count(), store.recover("check_results"), store.recover("check_results")) == (1, 1, 0)
    assert sorted(r.change_type for r in store.changes("check_results").collect()) == ["INSERT", "UPDATE_AFTER", "UPDATE_BEFORE"]
    commits = ResultStore._commits
    monkeypatch.setattr(ResultStore, "_commits", failing)
    with pytest.raises(RuntimeError):
        store.replace_runs("check_results", results(spark, "a", "ERROR"))
    monkeypatch.setattr(ResultStore, "_commits", commits)
    assert states(store.read("check_results")) == [("a", 0, "FAIL")]


def test_vacuum_takes_out_superseded_rows(spark):
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    later = dt.datetime(2024, 1, 2)
    for run, *s in (("a", "PASS"), ("a", "FAIL", "FAIL"), ("b", "PASS")):
        store.replace_runs("check_results", results(spark, run, *s))
    store.replace_runs("check_results", results(spark, "c", "PASS", moment=later))
    store.replace_runs("check_results", results(spark, "c").limit(0), results(spark, "c", "X", moment=later))
    before = states(store.read("check_results"))
    assert before == [("a", 0, "FAIL"), ("a", 1, "FAIL"), ("b", 0, "PASS")]
    store.vacuum("check_results", [dt.date(2024, 1, 1), later.date()])
    assert states(store.read("check_results")) == before
    assert spark.read.parquet(store.path("check_results")).where("unit IS NOT NULL").count() == 3


def test_a_unit_that_moves_to_another_day(spark):
    """Readers since a later day must not see what the unit held there before it moved back."""
    store = ResultStore(spark, scratch_path(spark, "test-store"))
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5)
    store.replace_runs("check_results", results(spark, "a", "FAIL", moment=late))
    store.replace_runs("check_results", results(spark, "a", "PASS", moment=early))
    assert states(store.read("check_results", late)) == []
    assert states(store.read("check_results")) == [("a", 0, "PASS")]
