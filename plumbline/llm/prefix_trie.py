"""A trie of conversation prefixes, its subtree totals by parallel tree contraction.

``places`` numbers the turns of each conversation. ``prefixes`` gives every prefix a name: the exclusive or of the hashes
of its turns, each taken with its place, in two lanes of 64 bits. Prefixes of equal depth and name are one node, known from
there on by its depth and the smallest id of its members, and no text travels any further.

``subtree_totals`` contracts the trie in rounds of joins. Rake folds every leaf into its parent; compress takes single
children out of unary chains, an independent set at a time, and hands what they hold to the edge below. Both shrink the
trie by a constant share, so the number of rounds grows with the logarithm of its nodes, however deep or wide it is. The
contracted nodes are then put back round by round, and each finds its total in that of the node it was
contracted into.

A conversation may hold a third of all turns, a prefix a third of all conversations: turns are dealt by ranges of their
order, running names are taken in slices of ``SLICE`` turns, ids that end at one node are listed in slices of ``SLICE`` values,
and children are counted and added up before they are shuffled.

Rows without a conversation id belong to no conversation and are left out. Turns without a number come first; turns with
the same number follow each other by role, then text. Null roles and texts are empty. Repeated rows are turns of their
own. Columns of other names are ignored. Without a conversation there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.spark import partitions
from plumbline.session import cut_lineage

SLICE = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def places(turns: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conv_id, place, h1, h2, words): each turn with its place from 1 and two hashes of its role and text.

    The rows are sorted by ranges. Within a range a row's number tells its place; a conversation that spans several
    ranges adds its rows in the ranges before.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    rows = turns.where(F.col(conversation).isNotNull()).select(
        F.col(conversation).alias("conv_id"), "turn", text["role"].alias("role"), text["text"].alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    ranged = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    marked = cut_lineage(ranged.select(
        "conv_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("role", "text").alias("h1"),
        F.xxhash64(F.lit(1), "role", "text").alias("h2"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words")),
        "turns").withColumn("range", F.shiftright("row", 33))
    runs = marked.groupBy("conv_id", "range").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv_id", "range", (F.col("first") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("start"))
    return marked.join(starts, ["conv_id", "range"]).select(
        "conv_id", (F.col("row") - F.col("start") + 1).alias("place"), "h1", "h2", "words")


def decimal(column: str) -> Column:
    return F.col(column).cast("string")


def rebuilt(turns: DataFrame, group: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that share their beginnings: ids (conv_id), and their turns (conv_id, place, h1, h2, words).

    Each id c takes the first h turns of conversation c - c % ``group``, then its own turns after the first h; h is the
    crc32 of the decimal id modulo ``most``.
    """
    placed = cut_lineage(places(turns), "places")
    ids = placed.select("conv_id").distinct().withColumn("h", F.crc32(decimal("conv_id").cast("binary")) % most)
    ids = cut_lineage(ids.withColumn("base", F.col("conv_id") - F.col("conv_id") % group), "ids")
    shared = placed.where(F.col("place") < most).withColumnRenamed("conv_id", "base")
    shared = shared.join(ids, "base").where("place <= h").select("conv_id", "place", "h1", "h2", "words")
    taken = ids.select("base").distinct().join(
        placed.where(F.col("place") < most).groupBy(F.col("conv_id").alias("base")).agg(F.max("place").alias("there")),
        "base", "left")
    heads = ids.join(taken, "base").select(
        "conv_id", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("head"))
    own = placed.join(heads, "conv_id").where("place > h").select(
        "conv_id", (F.col("place") - F.col("h") + F.col("head")).alias("place"), "h1", "h2", "words")
    return ids.select("conv_id"), cut_lineage(shared.unionByName(own), "rebuilt")


def prefixes(turns: DataFrame, slice_turns: int = SLICE) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, words, last): the names of each prefix and of the one a turn shorter.

    words are those of the prefix's last turn; last tells whether the conversation ends there.
    """
    rows = turns.select(
        "conv_id", "place", "words", F.floor((F.col("place") - 1) / slice_turns).alias("slice"),
        F.xxhash64("place", "h1").alias("t1"), F.xxhash64("place", "h2").alias("t2"))
    slices = rows.groupBy("conv_id", "slice").agg(
        F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"), F.max("place").alias("end"))
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        "conv_id", "slice", *[F.coalesce(F.bit_xor(f"s{k}").over(earlier), F.lit(0)).alias(f"b{k}") for k in (1, 2)],
        F.max("end").over(Window.partitionBy("conv_id")).alias("end"))
    so_far = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.select("*", *[F.bit_xor(f"t{k}").over(so_far).alias(f"r{k}") for k in (1, 2)])
    named = running.join(starts, ["conv_id", "slice"])
    here = [F.col(f"r{k}").bitwiseXOR(F.col(f"b{k}")) for k in (1, 2)]
    return named.select(
        "conv_id", F.col("place").alias("depth"), *[c.alias(f"p{k}") for k, c in enumerate(here, 1)],
        *[c.bitwiseXOR(F.col(f"t{k}")).alias(f"q{k}") for k, c in enumerate(here, 1)], "words",
        (F.col("place") == F.col("end")).alias("last"))


def nodes_of(ids: DataFrame, named: DataFrame) -> DataFrame:
    """(depth, conv_id, parent, n_convs, words, p1, p2) of every node; the root has depth 0 and no parent.

    Nodes below the root find their parent by its name. The root's smallest member is one number of the whole table.
    """
    nodes = cut_lineage(named.groupBy("depth", "p1", "p2", "q1", "q2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words")), "nodes")
    root = cut_lineage(ids.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")), "root")
    above = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("conv_id").alias("parent"))
    inner = nodes.where("depth > 1").join(above, ["depth", "q1", "q2"])
    first = nodes.where("depth = 1").withColumn("parent", root.select("conv_id").scalar())
    columns = ["depth", "conv_id", "parent", "n_convs", "words", "p1", "p2"]
    top = root.where("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), "conv_id", F.lit(None).cast("long").alias("parent"), "n_convs",
        F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    return inner.select(*columns).unionByName(first.select(*columns)).unionByName(top)


def _key(depth: str, conv: str) -> Column:
    """A node's key. A null member (of no node) gives no key."""
    return F.when(F.col(conv).isNotNull(), F.struct(F.col(depth).alias("depth"), F.col(conv).alias("conv_id")))


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(node, *values): the sums over the subtree of each node, itself included.

    ``nodes`` has node, parent (null: a root) and values; there must be no cycle. A live node holds the sum of itself and the
    leaves it took in (``a``), and the sum of the nodes taken out of the edge above it (``e``). What a node's total is made of
    when it goes: of a leaf, what it holds; of a unary node, that and the edge below and the total of its child.
    """
    held, edge = [f"a{k}" for k in range(len(values))], [f"e{k}" for k in range(len(values))]
    live = cut_lineage(nodes.select(
        "node", "parent", *[F.col(v).alias(a) for v, a in zip(values, held)],
        *[F.lit(0).cast("long").alias(e) for e in edge]), "live")
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        k = len(rounds)
        # Rake.
        parents = live.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        marked = cut_lineage(live.join(parents, "node", "left"), "rake")
        leaves = marked.where("n IS NULL")
        gone = leaves.select("node", F.lit(None).cast(live.schema["node"].dataType).alias("into"), *held)
        taken = leaves.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            *[F.sum(F.col(a) + F.col(e)).alias(f"t{i}") for i, (a, e) in enumerate(zip(held, edge))])
        rest = marked.where("n IS NOT NULL").drop("n").join(taken, "node", "left").select(
            "node", "parent", *[(F.col(a) + F.coalesce(f"t{i}", F.lit(0))).alias(a) for i, a in enumerate(held)], *edge)
        rest = cut_lineage(rest, "rest")
        # Compress: a unary node goes if its coin is up and that of its child, if unary itself, is not.
        below = rest.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.first("node").alias("child"),
            *[F.first(e).alias(f"c{i}") for i, e in enumerate(edge)])
        unary = cut_lineage(below.where("n = 1").drop("n").join(rest, "node").where("parent IS NOT NULL").withColumn(
            "up", F.xxhash64("node", F.lit(k)) % 2 == 0), "unary")
        under = unary.where("up").select(F.col("node").alias("child"))
        out = cut_lineage(unary.where("up").join(under, "child", "left_anti"), "out")
        spliced = out.select(
            F.col("child").alias("node"), F.col("parent").alias("__parent"),
            *[(F.col(a) + F.col(e)).alias(f"t{i}") for i, (a, e) in enumerate(zip(held, edge))])
        gone = gone.unionByName(out.select(
            "node", F.col("child").alias("into"), *[(F.col(a) + F.col(f"c{i}")).alias(a) for i, a in enumerate(held)]))
        live = cut_lineage(
            rest.join(out.select("node"), "node", "left_anti").join(spliced, "node", "left").select(
                "node", F.coalesce("__parent", "parent").alias("parent"), *held,
                *[(F.col(e) + F.coalesce(f"t{i}", F.lit(0))).alias(e) for i, e in enumerate(edge)]), "live")
        rounds.append(cut_lineage(gone, "gone"))
    # Expansion: the node that a contracted one went into went itself in a later round, so its total is known.
    totals = None
    for gone in reversed(rounds):
        leaves = gone.where("into IS NULL").select("node", *held)
        if totals is None:
            totals = leaves
            continue
        known = totals.select(F.col("node").alias("into"), *[F.col(a).alias(f"t{i}") for i, a in enumerate(held)])
        back = gone.where("into IS NOT NULL").join(known, "into").select(
            "node", *[(F.col(a) + F.col(f"t{i}")).alias(a) for i, a in enumerate(held)])
        totals = cut_lineage(totals.unionByName(leaves).unionByName(back), "totals")
    if totals is None:
        totals = live.select("node", *held)
    return totals.select("node", *[F.col(a).alias(v) for a, v in zip(held, values)])


def listed_ids(ends: DataFrame, keys: list[str], slice_ids: int = SLICE) -> DataFrame:
    """(keys, sha256): the digest of the ids (``conv_id``) of each key, ascending and joined by commas.

    Ids are listed in slices of ``slice_ids`` values. A key with one slice is digested there; those of more slices are read
    in order, a slice at a time, and never held together.
    """
    pieces = ends.groupBy(*keys, F.floor(F.col("conv_id") / slice_ids).alias("slice")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    pieces = cut_lineage(pieces, "pieces")
    counted = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("slices"), F.min("ids").alias("ids"))
    counted = cut_lineage(counted, "counted")
    single = counted.where("slices = 1").select(*keys, F.sha2(F.col("ids").cast("binary"), 256).alias("sha256"))
    several = pieces.join(counted.where("slices > 1").select(*keys), keys).select(
        F.struct(*keys).alias("key"), "slice", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None

        def done() -> pa.RecordBatch:
            return pa.record_batch(
                {"key": pa.array([current], key_type), "sha256": pa.array([running.hexdigest()], pa.string())})

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key == current:
                    running.update(b"," + ids.encode())
                    continue
                if running is not None:
                    yield done()
                current, running = key, hashlib.sha256(ids.encode())
        if running is not None:
            yield done()

    kind = several.schema["key"].dataType.simpleString()
    read = several.repartition("key").sortWithinPartitions("key", "slice").mapInArrow(digest, f"key {kind}, sha256 string")
    return single.unionByName(read.select("key.*", "sha256"))


EMPTY = hashlib.sha256(b"").hexdigest()


def trie(ids: DataFrame, turns: DataFrame, slice_turns: int = SLICE, slice_ids: int = SLICE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` are the conversations, ``turns`` their (conv_id, place, h1, h2, words). A node is known by its
    smallest member and its depth. saved_tokens are the words of last turns that repeat, over the subtree.
    """
    named = cut_lineage(prefixes(turns, slice_turns), "prefixes")
    nodes = cut_lineage(nodes_of(ids, named).withColumns({
        "node": _key("depth", "conv_id"), "up": F.col("depth") - 1}).withColumn("above", _key("up", "parent")), "trie")
    children = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("node")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "node", "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "children")
    totals = subtree_totals(nodes.select(
        "node", F.col("above").alias("parent"), (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    turnless = ids.join(turns.select("conv_id").distinct(), "conv_id", "left_anti").select(
        *[F.lit(0).cast("long").alias(c) for c in ("depth", "p1", "p2")], "conv_id")
    ends = named.where("last").select("depth", "p1", "p2", "conv_id").unionByName(turnless)
    digests = listed_ids(ends, ["depth", "p1", "p2"], slice_ids)
    return nodes.join(totals, "node").join(digests, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.lit(EMPTY)).alias("ends_sha256"))
