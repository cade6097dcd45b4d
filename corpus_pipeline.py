"""A corpus prepared for training, in stages that each read what the one before kept.

Every stage but the last returns the columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import host_quality, packing, simhash_trie, spaced_seeds, suffix_family
from plumbline.llm.spark import may_be_among, presence
from plumbline.session import cut_lineage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or those of their host, do not reject."""
    judged = host_quality.judged(docs.select(*COLUMNS), carry=COLUMNS[1:])
    return judged.where("kept").select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose ``doc_id`` is not in ``gone``; only texts that may be are shuffled for it."""
    words = presence(gone, F.xxhash64("doc_id"))
    may_go = F.arrow_udf(lambda hashes: pa.array(may_be_among(words, hashes.to_numpy())), "boolean")
    marked = may_go(F.xxhash64("doc_id"))
    return docs.where(~marked).unionByName(docs.where(marked).join(gone, "doc_id", "left_anti"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest id.

    Of rows that repeat an id one stays. Documents without an id stay, as no group can name them.
    """
    classes = cut_lineage(simhash_trie.near_copies(docs), "classes")
    gone = cut_lineage(classes.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    left = without(docs.select(*COLUMNS), gone)
    repeated = cut_lineage(
        classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        left = left.join(repeated, "doc_id", "left_anti").unionByName(
            left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return left.select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier document holds; documents that lose their last word go.

    A character that loses a byte goes whole.
    """
    cut = suffix_family.remove_repeats(docs.select(*COLUMNS), carry=COLUMNS[2:4], whole_characters=True)
    cut = cut.withColumn("text", F.col("kept").cast("string"))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return cut.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = spaced_seeds.contaminated(docs, benchmark).select("doc_id").distinct()
    return docs.join(cut_lineage(found, "contaminated"), "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in token sequences."""
    placed = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]

# Near copies, cutting by repeated bytes and packing by tokens have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
