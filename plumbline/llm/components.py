"""Connected components of a graph of links, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of type long); equal roots are connected.

    Each round points every node at its smallest neighbour or itself and replaces links by links between
    the nodes pointed at. Rounds alternate between the order of the numbers, which folds a star at once, and a
    random order, which shortens chains by a constant share: the number of rounds grows with the logarithm of
    the longest chain. Loops and repeated links are allowed; an empty table gives an empty table.
    """
    left = cut_lineage(links.select("a", "b").where("a <> b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        k = len(rounds)
        order = (lambda c: F.col(c)) if k % 2 == 0 else (lambda c, k=k: F.xxhash64(F.col(c), F.lit(k)))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = F.min(F.struct(order("b").alias("rank"), F.col("b").alias("node")))
        step = both.groupBy("a").agg(near.alias("near")).select(
            F.col("a").alias("node"),
            F.when(F.col("near.rank") < order("a"), F.col("near.node")).otherwise(F.col("a")).alias("to"))
        step = cut_lineage(step, "pointers")
        rounds.append(step)
        ends = [step.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        left = cut_lineage(
            left.join(ends[0], "a").join(ends[1], "b").where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "links")
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # A node keeps its pointer of the last round it took part in; later rounds move that on.
    roots = rounds[-1].select("node", F.col("to").alias("root"))
    for step in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("moved"))
        roots = step.join(later, "to", "left").select("node", F.coalesce("moved", "to").alias("root"))
    return roots
