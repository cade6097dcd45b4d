import hashlib
import random
import re
import zlib
from collections import defaultdict

import __spark_entry__ as entry
from pyspark.sql import functions as F

from plumbline.llm import prefix_trie as P
from tests import duck

DDL = "conv_id long, turn long, role string, text string"


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op13_prefix_trie"
    rows = duck.spark_rows(entry.queries()[name](spark, sf_dir))
    assert rows == duck.sql_rows(duck.connect(sf_dir), entry.oracle_sql()[name])


def sequences(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    return out


def brute(built):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p))
        for p, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "a b", "", None, "c  d\te", "long " * 20_000]))
            for c in range(45) for t in range(rng.randrange(1, 5))]
    rows += [(7, None, "user", "first"), (7, 2, "a", "tie"), (7, 2, "b", "tie"), (7, 2, "a", "tie"), (None, 1, "user", "gone"),
             (60, 0, "user", "x"), (61, 0, "user", "x"), (62, 0, "user", "x"), (62, 0, "user", "x"), (300, 5, None, None)]
    docs = spark.createDataFrame(rows, DDL).selectExpr("*", "1 AS place", "2 AS h1", "3 AS range", "'w' AS words", "4 AS row", "5 AS base")
    assert found(P.trie(*P.rebuilt(docs.repartition(7)))) == brute(sequences(rows))
    assert found(P.trie(*P.rebuilt(docs.limit(0)))) == []


def plain(spark, built):
    """Ids and turns as ``rebuilt`` returns them, of sequences that are given."""
    rows = [(c, k, r, t) for c, turns in built.items() for k, (r, t) in enumerate(turns, 1)]
    turns = spark.createDataFrame(rows, "conv_id long, place long, role string, text string").select(
        "conv_id", "place", F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "role", "text").alias("h2"),
        F.regexp_count("text", F.lit(P.WORDS)).cast("long").alias("words"))
    return spark.createDataFrame([(c,) for c in built], "conv_id long"), turns


def test_deep_chains_wide_nodes_and_slices(spark):
    chain = [("user", f"turn {k}") for k in range(60)]
    built = {0: chain, 1: chain[:40] + [("user", "off")], 2: chain[:40], 3: [], 4: chain}
    built |= {10 + k: [("user", "same"), ("assistant", f"own {k % 400}")] for k in range(900)}
    built |= {2000 + k: [("user", "end here")] for k in range(700)}
    for options in ({}, {"slice_turns": 16, "slice_ids": 100}):
        assert found(P.trie(*plain(spark, built), **options)) == brute(built)


def test_random_tries(spark):
    rng = random.Random(11)
    built = {c: [(rng.choice("ua"), rng.choice(["x", "x y", ""])) for _ in range(rng.randrange(7))] for c in range(150)}
    assert found(P.trie(*plain(spark, built))) == brute(built)


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """A path and a caterpillar of 400 nodes are contracted in few rounds."""
    written = []
    cut = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df, label="step": (written.append(label), cut(df, label))[1])
    for parent in (lambda k: k - 1, lambda k: k - 2 if k % 2 and k > 1 else k - 1):
        nodes = spark.createDataFrame(
            [(k, None if k == 0 else parent(k), 1) for k in range(400)], "node long, parent long, one long")
        written.clear()
        totals = {r.node: r.one for r in P.subtree_totals(nodes, ["one"]).collect()}
        expected = [1] * 400
        for k in range(399, 0, -1):
            expected[parent(k)] += expected[k]
        assert totals == dict(enumerate(expected)) and written.count("gone") <= 30


def test_places_of_a_hot_conversation(spark):
    rows = [(5, k // 3, "user", f"t{k % 3}") for k in range(3000)] + [(c, t, "user", "x") for c in range(100, 120) for t in range(5)]
    random.Random(1).shuffle(rows)
    placed = P.places(spark.createDataFrame(rows, DDL).repartition(9))
    by = defaultdict(list)
    for r in placed.collect():
        by[r.conv_id].append((r.place, r.h1))
    assert {c: [p for p, _ in sorted(v)] for c, v in by.items()} == {5: list(range(1, 3001))} | {
        c: [1, 2, 3, 4, 5] for c in range(100, 120)}
    hashes = [h for _, h in sorted(by[5])]
    assert len(set(hashes)) == 3 and hashes[:3] * 1000 == hashes
