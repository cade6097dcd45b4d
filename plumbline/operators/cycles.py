"""Cycles of a parent-child table: which nodes can reach each other, however many parents they have.

Each round every node takes one of its parents as its pointer; pointers are doubled, so that each chain of them is known
to its end after the logarithm of its length. Chains that go round are cycles, and each of them becomes one node; loose ends
are trimmed. If no chain goes round and all other links lead to nodes with shorter chains,
nothing is left that could be a cycle. Otherwise, and where little came together, every node gets the largest rank among the nodes it leads to, over
links and whole chains in turn. A node that keeps its own rank is the root of its colour, and what it leads to within
the colour is one group of nodes that reach each other. Links between colours and of found groups are dropped. Ranks are
drawn anew each round, so colours split in halves on average and few rounds are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.hierarchy import doubled, walk
from plumbline.operators.skew import present, probe
from plumbline.session import cut_lineage


def _rank(node: str, k: int) -> Column:
    return F.struct(F.xxhash64(F.col(node), F.lit(k)).alias("h"), F.col(node).alias("v"))


def _inner(links: DataFrame) -> DataFrame:
    """Links whose child has a child and whose parent has a parent; others lie on no cycle."""
    kept = probe(links, ["b"], links.select("a"), ["a"], "left_semi")
    return probe(kept, ["a"], links.select("b"), ["b"], "left_semi")


def _trimmed(links: DataFrame) -> DataFrame:
    """Links without their loose ends, again as long as that takes out an eighth of what is left."""
    before = links.count()
    while before:
        links = cut_lineage(_inner(links), "links")
        left = links.count()
        if left > before - before / 8:
            break
        before = left
    return links


def _chains(links: DataFrame, k: int) -> tuple[list[DataFrame], DataFrame, DataFrame | None]:
    """Pointers (node, far) of 1, 2, 4, ... steps, (node, far, hops) of the most steps, and the pointers that lie on cycles.

    Rounds point at the largest and at the smallest parent in turn: keys mostly grow one way along a hierarchy. What can
    be reached by as many steps gets fewer with the steps; once twice as many lead to as many nodes, all of these go round.
    """
    step = cut_lineage(links.groupBy(F.col("a").alias("node")).agg((F.min if k % 2 else F.max)("b").alias("far")).withColumn(
        "hops", F.lit(1).cast("long")), "pointers")
    steps, met = [step], None
    while True:
        moved = cut_lineage(doubled(step), "pointers")
        step, going = moved.select("node", "far", "hops"), moved.where("moves")
        ahead = going.select(F.col("via").alias("node")).distinct()
        n = ahead.count()
        if n == met:
            return steps, step, steps[0].join(ahead, "node", "left_semi").select("node", "far")
        if n == 0:
            return steps, step, None
        met = n
        steps.append(going.select("node", "far", "hops"))


def _rings(pointers: DataFrame) -> DataFrame:
    """(node, color) for pointers that all go round: the smallest node of each one's cycle.

    The smallest node of as many steps is that of the whole cycle once it is the same for the next as many, everywhere.
    """
    step = pointers.withColumn("low", F.col("node"))
    while True:
        ahead = step.select(F.col("node").alias("far"), F.col("far").alias("__far"), F.col("low").alias("__low"))
        step = cut_lineage(step.join(ahead, "far").select(
            "node", F.col("__far").alias("far"), F.least("low", "__low").alias("low"),
            (F.col("low") != F.col("__low")).alias("open")), "rings")
        if step.where("open").isEmpty():
            return step.select("node", F.col("low").alias("color"))
        step = step.drop("open")


def _absorbed(groups: DataFrame, found: DataFrame) -> DataFrame:
    """(node, color) after the nodes of ``found``, some of which stand for whole groups, came together."""
    moved = groups.join(found.select(F.col("node").alias("color"), F.col("color").alias("__new")), "color", "left").select(
        "node", F.coalesce("__new", "color").alias("color"))
    return cut_lineage(moved.unionByName(found.join(groups.select("node"), "node", "left_anti")), "groups")


def _contracted(links: DataFrame, found: DataFrame) -> DataFrame:
    """Links between groups: each node replaced by the one that stands for it."""
    for end in ("a", "b"):
        new = found.select(F.col("node").alias(end), F.col("color").alias("__new"))
        links = links.join(new, end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    return cut_lineage(links.where("a <> b").distinct(), "links")


# Joins that are planned together and written once.
AT_ONCE = 3


def _pairs(pointers: DataFrame) -> DataFrame:
    return pointers.select(F.col("node").alias("a"), F.col("far").alias("b"))


def _in_turn(state: DataFrame, step, all_links: list[DataFrame], label: str) -> DataFrame:
    """``state`` carried over each of the link tables, a few of them in one job."""
    for at, links in enumerate(all_links, 1):
        state = step(state, links)
        if at % AT_ONCE == 0 or at == len(all_links):
            state = cut_lineage(state, label)
    return state


def _largest(ranks: DataFrame, links: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(node, color): the largest rank among a node and all that it leads to."""
    chains = [_pairs(p) for p in reversed(steps)]
    ranks = _in_turn(ranks, _raised, chains, "ranks")
    while True:
        raised = cut_lineage(_raised(ranks, links), "ranks")
        same = raised.join(ranks.select("node", F.col("color").alias("old")), "node").where("color <> old").isEmpty()
        if same:
            return ranks
        ranks = _in_turn(raised, _raised, chains, "ranks")


def _raised(ranks: DataFrame, links: DataFrame) -> DataFrame:
    above = ranks.select(F.col("node").alias("b"), "color")
    best = links.join(above, "b").groupBy(F.col("a").alias("node")).agg(F.max("color").alias("__best"))
    return ranks.join(best, "node", "left").select("node", F.greatest("color", "__best").alias("color"))


def _further(found: DataFrame, links: DataFrame) -> DataFrame:
    beyond = links.join(found.select(F.col("node").alias("a")), "a", "left_semi").select(F.col("b").alias("node"))
    return found.unionByName(beyond).distinct()


def _led_to(starts: DataFrame, links: DataFrame, steps: list[DataFrame]) -> DataFrame:
    """(node): the starts and all nodes they lead to."""
    chains = [_pairs(p) for p in reversed(steps)]
    reached = _in_turn(starts, _further, chains, "found")
    fresh = reached
    while True:
        found = cut_lineage(_further(fresh, links).join(reached, "node", "left_anti"), "found")
        if found.isEmpty():
            return reached
        found = _in_turn(found, _further, chains, "found")
        fresh = cut_lineage(found.join(reached, "node", "left_anti"), "fresh")
        reached = cut_lineage(reached.unionByName(fresh), "reached")


def cycle_members(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(cycle_id, node, members): the nodes that lie on cycles, those that reach each other under one id.

    The id is the smallest of them, ``members`` their number. A node that is its own parent is a cycle of one. Branches that
    hang off a cycle, and whatever a cycle leads to, are no members. Repeated rows and absent ids change nothing.
    """
    links = cut_lineage(present(
        df.select(F.col(node).alias("a"), F.col(parent).alias("b")), ["a", "b"]).distinct(), "links")
    own = links.where("a = b").select(F.col("a").alias("node"))
    links = _trimmed(links.where("a <> b"))
    groups = own.limit(0).select("node", F.col("node").alias("color"))
    k = 0
    while size := links.count():
        steps, ends, round_ = _chains(links, k)
        k += 1
        if round_ is not None:
            # A cycle of pointers becomes one node. Where that leaves most of the links, ranks come next.
            found = _rings(round_)
            groups = _absorbed(groups, found)
            links = _trimmed(_contracted(links, found))
            if links.count() <= size - size / 4:
                continue
            if links.isEmpty():
                break
            steps, ends, round_ = _chains(links, k - 1)
        if round_ is None:
            here = ends.select(F.col("node").alias("a"), F.col("hops").alias("ha"))
            there = ends.select(F.col("node").alias("b"), F.col("hops").alias("hb"))
            if links.join(here, "a").join(there, "b").where("hb >= ha").isEmpty():
                break
        nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
        ranks = cut_lineage(nodes.withColumn("color", _rank("node", k)), "ranks")
        colors = _largest(ranks, links, steps)
        ends_of = [colors.select(F.col("node").alias(c), F.col("color").alias(f"{c}_color")) for c in ("a", "b")]
        inside = cut_lineage(
            links.join(ends_of[0], "a").join(ends_of[1], "b").where("a_color = b_color").select("a", "b"), "inside")
        colored = colors.withColumnRenamed("color", "c")
        chains = [
            p.join(colored, "node").join(colored.select(F.col("node").alias("far"), F.col("c").alias("d")), "far")
            .where("c = d").select("node", "far") for p in steps]
        roots = cut_lineage(colors.where(F.col("color") == _rank("node", k)).select("node"), "roots")
        found = _led_to(roots, inside, chains)
        members = found.join(colors, "node").select("node", F.col("color.v").alias("color"))
        several = members.groupBy("color").count().where("count > 1").select("color")
        groups = _absorbed(groups, cut_lineage(members.join(several, "color", "left_semi").select("node", "color"), "found"))
        left = inside.join(found.select(F.col("node").alias("a")), "a", "left_anti")
        left = left.join(found.select(F.col("node").alias("b")), "b", "left_anti")
        links = _trimmed(cut_lineage(left, "links"))
    every = own.join(groups.select("node"), "node", "left_anti").select("node", F.col("node").alias("color")).unionByName(groups)
    named = every.groupBy("color").agg(F.min("node").alias("cycle_id"), F.count(F.lit(1)).alias("members"))
    return every.join(named, "color").select("cycle_id", F.col("node").alias(node), "members")


def cycles_and_branches(df: DataFrame, node: str, parent: str) -> DataFrame:
    """(node, finding, cycle_id, members): CYCLE for members of cycles, BRANCH for nodes that lead to cycles only.

    A branch never leads to a root and lies on no cycle itself; a member that leads to a root as well is a member all the same.
    """
    members = cut_lineage(cycle_members(df, node, parent), "members")
    strays = probe(df.where(F.col(parent).isNotNull()), [parent], df, [node], "left_anti").select(node)
    met = walk(df, node, parent, None).select(node).unionByName(walk(df, node, parent, None, starts=strays).select(node))
    stuck = present(df.select(node), [node]).distinct().join(met.distinct(), node, "left_anti")
    branches = stuck.join(members.select(node), node, "left_anti").select(node, F.lit("BRANCH").alias("finding"))
    return members.withColumn("finding", F.lit("CYCLE")).unionByName(branches, allowMissingColumns=True).select(
        node, "finding", "cycle_id", "members")
