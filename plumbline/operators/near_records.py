"""Records that are nearly the same: one edit apart, or linked by others that are.

Values one replaced character apart are equal once that character is taken out; a value with one character more is the
other once it is taken out. So each value is dealt under all its forms with a character missing, and the values under one form
and place are all one edit apart: linking each to the smallest of them connects them, and no pair is formed twice or in
vain. The same form at any place links a value to the one that it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import key_counts
from plumbline.session import cut_lineage


def normal_form(columns: list[str]) -> Column:
    """The values of a record as one text: lower case, other than letters and digits one blank, columns apart."""
    parts = [F.coalesce(F.trim(F.regexp_replace(F.lower(F.col(c).cast("string")), r"[^\p{L}\p{N}]+", " ")), F.lit(""))
             for c in columns]
    return F.concat_ws("\x1f", *parts)


def one_edit_links(values: DataFrame) -> DataFrame:
    """(a, b): links that connect whatever distinct texts ``value`` are one edit apart, at most one for each form of a text."""
    places = F.sequence(F.lit(1), F.length("value"))
    formed = values.where(F.length("value") > 0).select("value", F.explode(places).alias("at")).select(
        "value", "at", F.concat(F.substring("value", F.lit(1), F.col("at") - 1),
                                F.substring("value", F.col("at") + 1, F.length("value"))).alias("form"))
    smallest = formed.groupBy("form", "at").agg(F.min("value").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    replaced = formed.join(smallest, ["form", "at"]).where("value <> a").select("a", F.col("value").alias("b"))
    removed = formed.join(values.select(F.col("value").alias("form")), "form").select(F.col("form").alias("a"), F.col("value").alias("b"))
    return replaced.unionByName(removed).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``links`` (a, b): the smallest node each is connected with.

    Every node points at the smallest of its neighbours and itself, and pointers are doubled until they rest; links
    between what has different ends are drawn between these ends, and so on. Each round at least halves the
    nodes that are still linked.
    """
    open_links = cut_lineage(links.where("a <> b").select("a", "b"), "links")
    ends = None
    while not open_links.isEmpty():
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select(
            "node", F.least("node", "to").alias("to")), "points")
        moving = True
        while moving:
            ahead = points.select(F.col("node").alias("to"), F.col("to").alias("further"))
            stepped = cut_lineage(points.join(ahead, "to", "left").select("node", "to", F.coalesce("further", "to").alias("next")), "points")
            moving = not stepped.where("next <> to").isEmpty()
            points = stepped.select("node", F.col("next").alias("to"))
        if ends is None:
            ends = points
        else:
            later = points.select(F.col("node").alias("to"), F.col("to").alias("last"))
            ends = cut_lineage(ends.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to")), "ends")
        sides = [points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b")]
        open_links = cut_lineage(open_links.join(sides[0], "a").join(sides[1], "b").where("a_to <> b_to").select(
            F.col("a_to").alias("a"), F.col("b_to").alias("b")).distinct(), "links")
    if ends is None:
        return open_links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return ends.select("node", F.col("to").alias("root"))


def near_records(df: DataFrame, columns: list[str]) -> DataFrame:
    """(value, rows, group_id, spellings, group_rows): the normal forms in groups of at least two.

    ``group_id`` is the smallest form of the group. Records are counted by form first, so copies cost nothing; columns are
    meant to be short, a text costs one row for each of its characters.
    """
    counted = cut_lineage(key_counts(df.select(normal_form(columns).alias("value")), ["value"], "rows"), "values")
    roots = cut_lineage(connected(one_edit_links(counted.select("value"))), "roots")
    members = counted.join(roots.select(F.col("node").alias("value"), F.col("root").alias("group_id")), "value")
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("spellings"), F.sum("rows").alias("group_rows"))
    return members.join(sizes, "group_id").select("value", "rows", "group_id", "spellings", "group_rows")
