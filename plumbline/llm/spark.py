"""Spark-side helpers of this package."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Text bytes whose entries one bucket holds in memory at a time.
BUCKET_BYTES = 24 << 20


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_count(docs: DataFrame, text: str = "text", per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets by the size of all texts, so that the memory of a task does not grow with the input."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(partitions(docs.sparkSession), math.ceil(size / per_bucket))


def by_bucket(packed: DataFrame, count: int) -> DataFrame:
    """Buckets dealt evenly over partitions and, inside a partition, one after another."""
    n = min(count, max(1, partitions(packed.sparkSession)) * 64)
    return packed.repartitionById(n, F.pmod("bucket", F.lit(n)).cast("int")).sortWithinPartitions("bucket")


# Bits that tell which hashes may be there: 4 MB on the driver and in a task, whatever the number of hashes.
PRESENCE_BITS = 25


def presence(hashes: DataFrame, column: Column) -> np.ndarray:
    """One bit for each beginning of a hash (a long), set if one of ``hashes`` begins so.

    Rows that surely lack a partner need not be shuffled for a join. The more hashes, the more rows pass
    for nothing; none that has a partner is lost.
    """
    slots = hashes.select(F.shiftrightunsigned(column, 64 - PRESENCE_BITS).alias("slot"))
    words = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS int)))").alias("bits")).toPandas()
    out = np.zeros(1 << (PRESENCE_BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def may_be_among(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.astype(np.int64).view(np.uint64) >> np.uint64(64 - PRESENCE_BITS)).view(np.int64)
    return (words[slot >> 6] >> (slot & 63) & 1).astype(bool)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def discard(written: DataFrame) -> None:
    """Delete the files of a table that ``cut_lineage`` wrote, once nothing that is still to run reads it."""
    spark = written.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    for folder in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
        if "/plumbline-" in folder:
            path = hadoop.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
