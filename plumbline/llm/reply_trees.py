"""Conversations out of reply trees: every root-to-leaf path, ranked by score, chosen paths formatted.

Messages point at what they reply to. Paths are enumerated by joining the messages with themselves again and again:
a table of jumps is joined with itself to reach twice as far, and extends the path of every leaf by the messages at
those distances, so the number of joins grows with the logarithm of the longest path and each message of each
path is produced once.

Formatting marks turns by control strings and escapes those that occur in texts: ``<`` followed by any
backslashes and ``|`` gets one more backslash, which ``parse`` takes off again. Roles escape backslash
and newline as well, for a newline ends a role.

Null texts and roles are empty. Messages without a tree id are a tree of their own, given back without an id. A message whose parent does not exist starts a path; messages on a cycle have no root
and belong to no path. A repeated id makes paths through each of its rows' texts undefined, so ids must be unique
(``chained`` makes them so for tables of turns). An empty table gives an empty result; other columns are
ignored. One formatted conversation is one row, as long as its texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# What stands for an absent tree id in joins; ids are decimal numbers there.
NO_TREE = "none"
LEARNED_ROLE = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation, and the code point ranges that a model is to learn: the texts of LEARNED_ROLE."""
    parts, mask, size = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == LEARNED_ROLE:
            mask.append((size + len(head), size + len(head) + len(body)))
        parts += [head, body, f"{CLOSE}\n"]
        size += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), mask


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    out = []
    for turn in text.split(OPEN)[1:]:
        role, body = turn.split("\n", 1)
        out.append((unescape_role(role), unescape(body[:-len(CLOSE) - 1])))
    return out


def chained(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Turns as messages (tree_id, message_id, parent_id, role, text, score): each replies to the one before.

    Rows are ordered by turn; rows of one turn by role and text, and repeated rows follow each other.
    """
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text")
    rows = turns.select(
        F.col(conversation).cast("long").alias("tree_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("message_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("message_id") > 1, F.col("message_id") - 1)
    return rows.select("tree_id", "message_id", parent.alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree_id, leaf_id, message_id, distance): every message of every root-to-leaf path, counted from the leaf."""
    links = cut_lineage(messages.select("tree_id", "message_id", "parent_id"), "messages")
    ids = links.select("tree_id", F.col("message_id").alias("parent_id"))
    sizes = links.groupBy("tree_id").agg(F.count(F.lit(1)).alias("size"))
    jumps = cut_lineage(links.join(ids, ["tree_id", "parent_id"]).join(sizes, "tree_id").select(
        "tree_id", "size", F.col("message_id").alias("from_id"), F.col("parent_id").alias("to_id")), "jumps")
    parents = jumps.select("tree_id", F.col("to_id").alias("message_id"))
    found = cut_lineage(links.join(parents, ["tree_id", "message_id"], "left_anti").select(
        "tree_id", F.col("message_id").alias("leaf_id"), "message_id", F.lit(0).cast("long").alias("distance")), "paths")
    reach = 1
    while not jumps.isEmpty():
        step = jumps.select("tree_id", F.col("from_id").alias("message_id"), "to_id")
        further = found.join(step, ["tree_id", "message_id"]).select(
            "tree_id", "leaf_id", F.col("to_id").alias("message_id"), (F.col("distance") + reach).alias("distance"))
        found = cut_lineage(found.unionByName(further), "paths")
        reach *= 2
        # A path is no longer than its tree; what is left of longer jumps goes round a cycle.
        later = jumps.select("tree_id", F.col("from_id").alias("to_id"), F.col("to_id").alias("end_id"))
        jumps = cut_lineage(jumps.where(F.col("size") > reach).join(later, ["tree_id", "to_id"]).select(
            "tree_id", "size", "from_id", F.col("end_id").alias("to_id")), "jumps")
    rooted = found.join(
        links.join(ids.select("tree_id", F.col("parent_id")), ["tree_id", "parent_id"], "left_anti")
        .select("tree_id", "message_id"), ["tree_id", "message_id"], "left_semi").select("tree_id", "leaf_id")
    return found.join(rooted.distinct(), ["tree_id", "leaf_id"], "left_semi")


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree_id, leaf_id, rank, score, n_turns, formatted, loss_mask), one row per chosen path.

    Paths of a tree are ranked by their mean message score, the smaller leaf id first among equals; with ``branches``
    only that many of each tree are formatted. loss_mask lists code point ranges of ``formatted``.
    """
    messages = messages.withColumn("tree_id", F.coalesce(F.col("tree_id").cast("string"), F.lit(NO_TREE)))
    on_path = cut_lineage(paths(messages), "on_path")
    texts = messages.select("tree_id", "message_id", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"))
    scores = on_path.join(texts.select("tree_id", "message_id", "score"), ["tree_id", "message_id"])
    ranked = scores.groupBy("tree_id", "leaf_id").agg(F.avg("score").alias("score")).withColumn(
        "rank", F.row_number().over(Window.partitionBy("tree_id").orderBy(F.desc("score"), "leaf_id")))
    if branches is not None:
        ranked = ranked.where(F.col("rank") <= branches)
    turn = F.struct(-F.col("distance"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    gathered = (
        on_path.join(texts.drop("score"), ["tree_id", "message_id"]).groupBy("tree_id", "leaf_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("turns")).join(ranked, ["tree_id", "leaf_id"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [formatted([(t["role"], t["text"]) for t in row]) for row in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:4], pa.array([len(r) for r in batch.column(4)], pa.int64()),
                pa.array([m[0] for m in made], pa.string()),
                pa.array([[{"start": a, "end": b} for a, b in m[1]] for m in made],
                         pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["tree_id", "leaf_id", "rank", "score", "n_turns", "formatted", "loss_mask"])

    return gathered.select("tree_id", "leaf_id", "rank", "score", "turns").mapInArrow(
        run, "tree_id string, leaf_id long, rank int, score double, n_turns long, formatted string, "
             "loss_mask array<struct<start:long,end:long>>"
    ).withColumn("tree_id", F.when(F.col("tree_id") != NO_TREE, F.col("tree_id").cast("long")))


def digests(made: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and learned texts, as digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, mask in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = parse(text)
                learned = "".join(unescape(text[m["start"]:m["end"]]) for m in mask)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned),
                             hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return made.select("tree_id", "formatted", "loss_mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
             "formatted_chars long")
