"""Tree walks and log order against plain loops."""

import random

import pytest

from plumbline.operators import hierarchy
from plumbline.operators.change_order import order_violations, with_previous


def reachable(rows, starts, limit=None):
    children = {}
    for node, parent in rows:
        if parent is not None:
            children.setdefault(parent, set()).add(node)
    depth, seen, front = 1, dict.fromkeys(starts, 1), set(starts)
    while front and (limit is None or depth < limit):
        depth += 1
        front = {c for p in front for c in children.get(p, ())} - set(seen)
        seen.update(dict.fromkeys(front, depth))
    return seen


TREES = {
    "random": [(i, random.Random(i).choice([None, *range(max(0, i - 9), i)]) if i else None) for i in range(120)],
    "chain": [(i, i - 1 if i else None) for i in range(12)],
    "long cycle": [(0, None), (1, 0), (2, 4), (3, 2), (4, 3), (5, 4), (6, 6)],
    "repeated ids": [(0, None), (1, 0), (1, 3), (2, 1), (3, 2), (4, 99), (5, 4), (5, 4)],
    "hot parent": [(0, None)] + [(i, 0) for i in range(1, 200)] + [(1000 + i, i) for i in range(50)],
}


@pytest.mark.parametrize("name", list(TREES))
@pytest.mark.parametrize("limit", [1, 3, 50])
def test_unreachable(spark, name, limit):
    rows = TREES[name]
    df = spark.createDataFrame(rows, "id bigint, p bigint")
    seen = reachable(rows, [n for n, p in rows if p is None], limit)
    found = hierarchy.unreachable_nodes(df, "id", "p", limit).collect()
    assert sorted(r.id for r in found) == sorted(n for n, _ in rows if n not in seen)


@pytest.mark.parametrize("name", list(TREES))
def test_depth_and_cycles(spark, name):
    rows = TREES[name]
    df = spark.createDataFrame(rows, "id bigint, p bigint")
    ids = {n for n, _ in rows}
    from_roots = reachable(rows, [n for n, p in rows if p is None])
    from_strays = reachable(rows, [n for n, p in rows if p is not None and p not in ids])
    expected = {(n, "TOO_DEEP", d) for n, d in from_roots.items() if d > 4}
    expected |= {(n, "NO_ROOT", None) for n in from_strays if n not in from_roots}
    expected |= {(n, "CYCLE", None) for n in ids if n not in from_roots and n not in from_strays}
    found = hierarchy.depth_and_cycles(df, "id", "p", 4).collect()
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_a_long_chain_takes_few_rounds(spark):
    n = 10_000
    df = spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN id - 1 END AS p")
    found = {r.finding: r.n for r in hierarchy.depth_and_cycles(df, "id", "p", 4).groupBy("finding").count().withColumnRenamed(
        "count", "n").collect()}
    assert found == {"TOO_DEEP": n - 4}


def change_rows():
    rng = random.Random(8)
    keys = ["hot"] * 200 + ["a", "b", None] * 40
    return [(i, k, rng.randint(0, 60), rng.randint(0, 30), rng.choice("IUD")) for i, k in enumerate(keys)]


def test_previous_row_of_hot_keys(spark):
    rows = change_rows()
    df = spark.createDataFrame(rows, "id bigint, k string, t int, s int, op string").repartition(6)
    expected = {}
    for key in {r[1] for r in rows}:
        ordered = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[3], r[0]))
        for before, row in zip([None, *ordered], ordered):
            expected[row[0]] = (before[3], before[4]) if before else (None, None)
    found = with_previous(df.dropna(), ["k"], ["t", "s", "id"], ["s", "op"]).collect()
    assert {r.id: (r.prev_s, r.prev_op) for r in found} == {
        i: v for i, v in expected.items() if rows[i][1] is not None}


def test_order_findings(spark):
    rows = [(1, "a", 1, 1, "I"), (2, "a", 2, 5, "D"), (3, "a", 3, 5, "I"), (4, "a", 4, 4, "U"), (5, "b", 1, 9, "I"),
            (6, "b", 2, 9, "U")]
    df = spark.createDataFrame(rows, "id bigint, k string, t int, s int, op string")
    found = order_violations(df, ["k"], "s", "t", "op", "id").collect()
    assert sorted((r.record_id, r.finding) for r in found) == [
        (3, "DELETE_BEFORE_INSERT"), (4, "NOT_INCREASING"), (6, "NOT_INCREASING")]


def test_no_side_of_a_walk_is_broadcast(spark):
    """However small the files are: at size each side is a table of all nodes."""
    rows = spark.createDataFrame([(i, i // 3 if i else None) for i in range(300)], "n long, up long")
    found = hierarchy.depth_and_cycles(rows, "n", "up", 3)
    pointers = rows.where("n > 0").selectExpr("n AS node", "up AS far", "1L AS hops")
    for df in (found, hierarchy.doubled(pointers), hierarchy.unreachable_nodes(rows, "n", "up", 3)):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
