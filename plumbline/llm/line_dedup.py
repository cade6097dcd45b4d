"""Lines that many documents share, dropped from all but one of them.

Every line is exploded with its position, normalised and hashed; documents are counted once per hash, and lines whose
hash is found in too many documents go, except from the document with the largest id that holds them. What stays is
put together again by position.

Lines are known by two 64-bit hashes, so that lines are counted and looked up without their texts. The document ids of a
common line are counted, never gathered, and its rows are looked up in a join that adaptive execution may split. Only
documents that lose a line are joined with the positions they lose.

A null or empty text is one empty line. Rows that repeat an id count as one document, and each of them is given back.
A row without an id is no document that could be counted, and none that a line is left to. Columns of other names
than those given are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_CHARS, MIN_DOCUMENTS = 40, 5


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE))


def line_key(line: Column) -> Column:
    """Without white space at both ends, only A-Z lower-cased."""
    bare = stripped(line)
    plain = F.octet_length(bare) == F.length(bare)
    return F.when(plain, F.lower(bare)).otherwise(F.translate(bare, CAPITALS, CAPITALS.lower()))


def lines_of(text: str) -> Column:
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")


def long_lines(docs: DataFrame, id_column: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, text_hash, position, h1, h2) of each line whose key has at least ``min_chars`` characters."""
    # The hash of a text is taken before its lines are exploded: once for the text, not for each line.
    whole = docs.select(
        F.col(id_column).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), lines_of(text).alias("lines"))
    lines = whole.select("doc_id", "text_hash", F.posexplode("lines").alias("position", "line"))
    key = line_key(F.col("line"))
    return lines.where(
        (F.octet_length("line") >= min_chars) & (F.length(stripped(F.col("line"))) >= min_chars)
    ).select("doc_id", "text_hash", "position", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def common_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """(h1, h2, documents, keeper): keys of at least ``min_documents`` documents and the largest id among these."""
    held = long_lines(docs, id_column, text, min_chars).where("doc_id IS NOT NULL").groupBy("h1", "h2", "doc_id").agg(
        F.count(F.lit(1)).alias("rows"))
    return held.groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("documents"), F.max("doc_id").alias("keeper")
    ).where(F.col("documents") >= min_documents)


def without_common_lines(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): one row for each row of ``docs``; kept is the text that stays."""
    common = cut_lineage(common_lines(docs, id_column, text, min_chars, min_documents), "common_lines")
    lost = long_lines(docs, id_column, text, min_chars).join(common, ["h1", "h2"]).where(
        ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # Repeated rows of one id and text lose the same positions, so each position is kept once.
    lost = lost.groupBy(F.col("doc_id").alias("lost_id"), F.col("text_hash").alias("lost_hash")).agg(
        F.collect_set("position").alias("gone"))
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    lines = F.col("lines")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n"))
    return rows.join(
        lost, F.col("doc_id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left"
    ).withColumn("lines", lines_of("text")).select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
