"""Cycles and shortcuts against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import cycles, hierarchy


def components(rows):
    """Nodes that reach each other, by what each reaches."""
    links = {}
    for a, b in rows:
        if a is not None and b is not None:
            links.setdefault(a, set()).add(b)
    reach = {}
    for a in links:
        seen, front = set(), set(links[a])
        while front:
            seen |= front
            front = {c for b in front for c in links.get(b, ())} - seen
        reach[a] = seen
    groups = {}
    for a in reach:
        if a in reach[a]:
            members = {b for b in reach[a] if a in reach.get(b, ())}
            groups[min(members)] = members
    return {(i, m, len(members)) for i, members in groups.items() for m in members}


def graph(seed, n, links):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(links)]


GRAPHS = {
    "sparse": graph(1, 60, 60), "dense": graph(2, 30, 90),
    "none": [(k, k - 1) for k in range(1, 20)] + [(0, None)],
    "rings": [(10 * r + k, 10 * r + (k + 1) % 7) for r in range(4) for k in range(7)] + [(7, 3), (8, 7), (13, 0), (None, 1)],
    "self": [(1, 1), (2, 1), (2, 2), (2, 2), (3, None)], "two joined": [(0, 1), (1, 0), (1, 2), (2, 3), (3, 2), (3, 0)],
}


@pytest.mark.parametrize("name", list(GRAPHS))
def test_members(spark, name):
    df = spark.createDataFrame(GRAPHS[name], "id bigint, p bigint")
    found = cycles.cycle_members(df, "id", "p").collect()
    assert {(r.cycle_id, r.id, r.members) for r in found} == components(GRAPHS[name]) and len(found) == len({r.id for r in found})


def test_text_keys_and_empty_table(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "id string, p string")
    assert {tuple(r) for r in cycles.cycle_members(df, "id", "p").collect()} == {("a", "a", 2), ("a", "b", 2)}
    assert {tuple(r) for r in cycles.cycles_and_branches(df, "id", "p").collect()} == {
        ("a", "CYCLE", "a", 2), ("b", "CYCLE", "a", 2), ("c", "BRANCH", None, None)}
    assert cycles.cycle_members(df.limit(0), "id", "p").count() == 0


def test_jobs_do_not_follow_the_depth(spark, monkeypatch):
    """2,000 nodes of two parents each, a ring at the far end: steps are written some hundred times, not thousands."""
    n = 2_000
    df = spark.range(n).select(F.col("id"), F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("p")).where("p >= 0")
    df = df.unionByName(spark.createDataFrame([(0, 3)], "id bigint, p bigint"))
    written = []
    for module in (cycles, hierarchy):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda d, label="s", cut=cut: (written.append(label), cut(d, label))[1])
    found = cycles.cycle_members(df, "id", "p").collect()
    assert {(r.cycle_id, r.id, r.members) for r in found} == {(0, k, 4) for k in range(4)}
    assert len(written) < 150
    written.clear()
    rooted = df.where("NOT (id = 0 AND p = 3)").unionByName(spark.createDataFrame([(0, None)], "id bigint, p bigint"))
    depths = {r.id: r.depth for r in hierarchy.walk(rooted, "id", "p", None).collect()}
    assert depths == {k: 1 + (k + 1) // 2 for k in range(n)} and len(written) < 60


def test_steps_follow_the_cycles_and_not_the_number_of_nodes(spark, monkeypatch):
    """Rings of ten with a tail each: as many steps are written for 4,000 nodes as for 40."""
    written = []
    for module in (cycles, hierarchy):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda d, label="s", cut=cut: (written.append(label), cut(d, label))[1])
    steps = []
    for n in (40, 4_000):
        df = spark.range(n).selectExpr("id", "CASE WHEN id % 20 = 0 THEN id + 9 ELSE id - 1 END AS p")
        written.clear()
        found = {(r.cycle_id, r.id, r.members) for r in cycles.cycle_members(df, "id", "p").collect()}
        assert found == {(k - k % 20, k, 10) for k in range(n) if k % 20 < 10}
        assert hierarchy.walk(df, "id", "p", None).count() == 0
        steps.append(len(written))
    assert steps[0] == steps[1] < 40


def test_links_both_ways(spark):
    """A path whose links lead both ways is one group, though pointers find its ends only."""
    df = spark.range(6).select("id", F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("p")).where("p BETWEEN 0 AND 5")
    found = {(r.cycle_id, r.id, r.members) for r in cycles.cycle_members(df, "id", "p").collect()}
    assert found == {(0, k, 6) for k in range(6)}
