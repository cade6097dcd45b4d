"""Differences, distances of samples and near records against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import differences, near_records, stat_checks
from plumbline.operators.differences import Range
from plumbline.session import scratch_path


def outer(a, b):
    """Keys whose multisets of rows differ."""
    by = [{}, {}]
    for side, rows in zip(by, (a, b)):
        for r in rows:
            side.setdefault(r[0], []).append(r)
    out = set()
    for k in {*by[0], *by[1]}:
        x, y = by[0].get(k, []), by[1].get(k, [])
        if sorted(x, key=repr) != sorted(y, key=repr):
            out.add((k, "MISSING" if not y else "EXTRA" if not x else "CHANGED", len(x), len(y)))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_differing_keys(spark, seed):
    rng = random.Random(seed)
    a = [(rng.choice([None, *range(-500, 500)]), rng.choice("ab"), float(rng.randrange(3))) for _ in range(600)]
    b = [r for r in a if r[0] is None or not 20 < r[0] < 30] + [(9000, "z", 1.0), (9000, "z", 1.0), (None, "n", 0.0)]
    b = [(k, v, n + 1 if k == 77 else n) for k, v, n in b]
    ddl = "k bigint, v string, n double"
    source, target = spark.createDataFrame(a, ddl), spark.createDataFrame(b, ddl).repartition(5)
    for buckets in (4, 64, 4096):
        found = {tuple(r) for r in differences.differing_keys(source, target, "k", ["k", "v", "n"], buckets).collect()}
        assert found == outer(a, b)
    assert differences.differing_keys(source, source, "k", ["v", "n"]).count() == 0
    assert differences.differing_keys(source.limit(0), target, "k", ["v"]).count() == target.select("k").distinct().count()
    assert differences.differing_keys(source.limit(0), target.limit(0), "k", ["v"]).count() == 0


def test_text_and_date_keys(spark):
    a = spark.range(300).selectExpr("concat('k', id) AS t", "date_add(DATE'2024-01-01', CAST(id AS INT)) AS d", "id AS v")
    b = a.where("v <> 7").withColumn("v", F.when(F.col("v") == 9, F.lit(0)).otherwise(F.col("v")))
    for key in ("t", "d"):
        found = {(r.finding, r.source_rows, r.target_rows) for r in differences.differing_keys(a, b, key, ["v"]).collect()}
        assert found == {("MISSING", 1, 0), ("CHANGED", 1, 1)}


def test_only_differing_ranges_are_read(spark):
    path = scratch_path(spark, "big")
    spark.range(200_000).selectExpr("id AS k", "id * 2 AS v").write.parquet(path)
    a = spark.read.parquet(path)
    b = a.withColumn("v", F.when(F.col("k").between(70_000, 70_005), 0).otherwise(F.col("v")))
    assert differences.differing_ranges(a, b, "k", ["v"]) == [Range(70_000, 70_005)]
    found = differences.differing_keys(a, b, "k", ["v"])
    assert found.count() == 6
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [Or(IsNull(k),And(GreaterThanOrEqual(k,70000),LessThanOrEqual(k,70005)))]") == 2


def test_ranges_are_merged_at_the_smallest_gaps():
    ranges = [Range(0, 1), Range(2, 5), Range(9, 9), Range(100, 101), Range(103, 104)]
    assert differences._merged(ranges, 64) == [Range(0, 5), Range(9, 9), Range(100, 101), Range(103, 104)]
    assert differences._merged(ranges, 2) == [Range(0, 9), Range(100, 104)]
    assert differences._merged(ranges, 1) == [Range(0, 104)]


def ks(a, b):
    best = (-1.0, None)
    for v in sorted({*a, *b}):
        gap = abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b))
        best = (gap, v) if gap > best[0] else best
    return best


def test_largest_gap(spark):
    rng = random.Random(4)
    for a, b in (
        ([rng.gauss(0, 1) for _ in range(200)], [rng.gauss(1, 1) for _ in range(150)]),
        ([float(rng.randrange(4)) for _ in range(300)], [float(rng.randrange(4)) for _ in range(50)]), ([1.0], [2.0, 2.0])):
        one, two = (spark.createDataFrame([(x,) for x in [*s, None]], "v double").repartition(3) for s in (a, b))
        r = stat_checks.largest_gap(one, two, "v").first()
        assert (r.n_now, r.n_base, r.distance, r.at_value) == (len(a), len(b), *ks(a, b))
        assert r.shifted == (r.distance > r.allowed)
    r = stat_checks.largest_gap(one, two.limit(0), "v").first()
    assert (r.n_base, r.distance, r.at_value, r.shifted) == (0, None, None, None)


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_near_records(spark):
    rng = random.Random(6)
    values = {"".join(rng.choice("abé") for _ in range(rng.randrange(0, 7))) for _ in range(160)} | {"", "a"}
    rows = [(v.upper() if rng.random() < .3 else f" {v}!", None) for v in values for _ in range(rng.randrange(1, 4))]
    rows += [("hot value", "x")] * 500 + [("hot valeu", "x"), ("hot vlue", "x"), (None, None)]
    df = spark.createDataFrame(rows, "v string, w string")
    counts = {r.value: r.n for r in df.select(near_records.normal_form(["v", "w"]).alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    root = {v: v for v in counts}
    changed = True
    while changed:
        changed = False
        for a in counts:
            for b in counts:
                if distance_one(a, b) and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    groups = {}
    for v, r in root.items():
        groups.setdefault(r, []).append(v)
    expected = {(v, counts[v], r, len(g), sum(counts[x] for x in g)) for r, g in groups.items() if len(g) > 1 for v in g}
    assert {tuple(r) for r in near_records.near_records(df, ["v", "w"]).collect()} == expected
    assert near_records.near_records(df.limit(0), ["v"]).count() == 0
