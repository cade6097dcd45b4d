"""Walks over parent-child tables by pointer doubling: the number of joins grows with the logarithm of the depth.

Both sides of these joins have as many rows as there are nodes. They are merged, so that none passes through the driver
in round after round because its file happens to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import unreachable
from plumbline.operators.skew import present, probe
from plumbline.session import cut_lineage


def doubled(pointers: DataFrame) -> DataFrame:
    """Pointers (node, far, hops) of twice the steps; those that ``moves`` went on from ``via``."""
    ahead = pointers.select(F.col("node").alias("__at"), F.col("far").alias("__far"), F.col("hops").alias("__hops"))
    return pointers.join(ahead.hint("merge"), pointers["far"] == ahead["__at"], "left").select(
        "node", F.coalesce("__far", "far").alias("far"), (F.col("hops") + F.coalesce("__hops", F.lit(0))).alias("hops"),
        F.col("__at").isNotNull().alias("moves"), F.col("far").alias("via"))


def _to_ends(links: DataFrame, max_hops: int | None) -> DataFrame:
    """(node, end, hops): where the only parent links (node, up) lead, each node's chain followed to its end.

    All pointers are joined with themselves, so each round doubles their reach. What still moves gets to fewer nodes with
    each round; once twice the steps lead to as many, all that moves goes round cycles and is dropped, as is a pointer that still
    moves beyond ``max_hops``. So rounds follow the longest chain that leads somewhere, not the number of nodes.
    """
    reach, met = 1, None
    pointers = links.select("node", F.col("up").alias("far"), F.lit(1).cast("bigint").alias("hops"))
    while True:
        moved = cut_lineage(doubled(pointers), "pointers")
        pointers = moved.select("node", "far", "hops")
        reach *= 2
        ahead = moved.where("moves").select("via").distinct().count()
        if ahead in (0, met) or (max_hops is not None and reach > max_hops):
            break
        met = ahead
    ends = pointers.select(F.col("node").alias("far")).distinct()
    # What ends at a node that has a pointer itself has not arrived.
    return pointers.join(ends.hint("merge"), "far", "left_anti").select("node", F.col("far").alias("end"), "hops")


def _with_shortcuts(steps: DataFrame, max_hops: int | None) -> DataFrame:
    """The steps (node, end, hops) and, for each node, those of 2, 4, 8, ... steps along nearest ends.

    Every shortcut has the length of the path it stands for, so smallest depths stay what they are.
    """
    far = cut_lineage(steps.groupBy("node").agg(F.min(F.struct("hops", "end")).alias("s")).select(
        "node", "s.end", "s.hops"), "nearest")
    most, reach, found = far.count(), 1, steps
    if max_hops is not None:
        most = min(most, max_hops)
    while reach <= most:
        ahead = far.select(F.col("node").alias("end"), F.col("end").alias("__end"), F.col("hops").alias("__hops"))
        far = cut_lineage(far.join(ahead.hint("merge"), "end").select(
            "node", F.col("__end").alias("end"), (F.col("hops") + F.col("__hops")).alias("hops")), "nearest")
        if far.isEmpty():
            break
        found = found.unionByName(far)
        reach *= 2
    return cut_lineage(found.groupBy("node", "end").agg(F.min("hops").alias("hops")), "steps")


def walk(df: DataFrame, node: str, parent: str, max_depth: int | None, starts: DataFrame | None = None) -> DataFrame:
    """Every node reached from the roots, with its depth (roots have depth 1).

    A node counts once, at its smallest depth, so repeated ids and cycles end the walk. Chains of nodes with one parent
    are followed by pointer doubling down to their ends: roots, unknown parents and nodes with several parents. Those
    last are walked from end to end, with the chains of their nearest parents as shortcuts, so that the steps follow the
    changes from one such chain to another and not the depth.
    """
    edges = cut_lineage(
        present(df.select(F.col(node).alias("node"), F.col(parent).alias("up")), ["node", "up"]).distinct(), "edges")
    if starts is None:
        starts = present(df.where(F.col(parent).isNull()).select(node), [node])
    roots = cut_lineage(starts.select(F.col(node).alias("node")).distinct(), "roots")
    inner = cut_lineage(probe(edges.hint("merge"), ["node"], roots, ["node"], "left_anti"), "inner")
    parents = inner.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("up"))
    several = probe(inner.hint("merge"), ["node"], parents.where("n > 1"), ["node"], "left_semi")
    chains = _to_ends(cut_lineage(parents.where("n = 1").select("node", "up"), "chains"), max_depth)
    depths = roots.select("node", F.lit(1).cast("bigint").alias("depth"))
    if not several.isEmpty():
        steps = several.join(chains.select(F.col("node").alias("up"), "end", "hops").hint("merge"), "up", "left").select(
            "node", F.coalesce("end", "up").alias("end"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"))
        steps = cut_lineage(steps.groupBy("node", "end").agg(F.min("hops").alias("hops")), "steps")
        steps = _with_shortcuts(steps, max_depth)
        depths = cut_lineage(depths, "depths")
        changed = depths
        while not changed.isEmpty():
            reached = steps.join(changed.select(F.col("node").alias("end"), "depth"), "end").groupBy("node").agg(
                F.min(F.col("depth") + F.col("hops")).alias("depth"))
            if max_depth is not None:
                reached = reached.where(F.col("depth") <= max_depth)
            known = depths.select("node", F.col("depth").alias("known"))
            changed = cut_lineage(reached.join(known.hint("merge"), "node", "left").where(
                "known IS NULL OR depth < known").select("node", "depth"), "changed")
            depths = cut_lineage(
                depths.unionByName(changed).groupBy("node").agg(F.min("depth").alias("depth")), "depths")
    below = chains.join(depths.select(F.col("node").alias("end"), "depth").hint("merge"), "end").select(
        "node", (F.col("depth") + F.col("hops")).alias("depth"))
    out = depths.unionByName(below)
    if max_depth is not None:
        out = out.where(F.col("depth") <= max_depth)
    return cut_lineage(out.select(F.col("node").alias(node), F.col("depth").cast("int").alias("depth")), "walk")


def unreachable_nodes(df: DataFrame, node: str, parent: str, max_depth: int) -> DataFrame:
    """Rows not reached from a root within ``max_depth`` levels."""
    return unreachable(df.hint("merge"), node, walk(df, node, parent, max_depth))


def depth_and_cycles(df: DataFrame, node: str, parent: str, max_depth: int) -> DataFrame:
    """Nodes that lie too deep, hang below an unknown parent, or never lead to a root.

    The last kind is a cycle of any length, or a branch that hangs off one.
    """
    from_roots = walk(df, node, parent, None)
    strays = probe(df.where(F.col(parent).isNotNull()).hint("merge"), [parent], df, [node], "left_anti").select(node)
    from_strays = walk(df, node, parent, None, starts=strays)
    deep = from_roots.where(F.col("depth") > max_depth).select(
        node, F.lit("TOO_DEEP").alias("finding"), F.col("depth").cast("bigint").alias("depth")
    )
    stray = from_strays.join(from_roots.select(node).hint("merge"), node, "left_anti").select(
        node, F.lit("NO_ROOT").alias("finding"), F.lit(None).cast("bigint").alias("depth")
    )
    met = from_roots.select(node).unionByName(from_strays.select(node))
    looping = (
        present(df.select(node), [node]).distinct().join(met.distinct().hint("merge"), node, "left_anti")
        .select(node, F.lit("CYCLE").alias("finding"), F.lit(None).cast("bigint").alias("depth"))
    )
    return deep.unionByName(stray).unionByName(looping)
