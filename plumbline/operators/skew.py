"""Building blocks that keep hot keys from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut_lineage


def key_counts(df: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Rows per key. Map-side partial aggregation reduces a hot key to one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


# Longer text is grouped by a fingerprint one character longer than any text kept as it is.
KEPT_TEXT = 64


def compact_key(column: str, schema: T.StructType) -> Column:
    """A grouping key equal exactly when the column is equal, of bounded width for text."""
    value = F.col(column)
    if not isinstance(schema[column].dataType, T.StringType):
        return value
    return F.when(
        F.length(value) > KEPT_TEXT, F.concat(F.lit("#"), F.sha2(value, 256))
    ).otherwise(value).alias(column)


def group_apart(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group by ``keys`` for a join on the same keys whose *other* side may have hot keys.

    Adaptive execution splits a hot partition of a join only where both inputs come straight from
    a shuffle. A plain aggregate sits between its shuffle and the join. With a hash as an extra
    grouping key (it changes no group) the aggregate is partitioned differently from the join, which
    then shuffles the groups, one row per key, by itself.
    """
    grouped = df.groupBy(*keys, F.xxhash64(*keys).alias("__apart"))
    if not aggregates:
        aggregates = (F.count(F.lit(1)).alias("__rows"),)
    return grouped.agg(*aggregates).drop("__apart", "__rows")


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every given column, as a filter that reaches the scan."""
    for column in columns:
        df = df.where(F.col(column).isNotNull())
    return df


def lookup_side(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The distinct keys of the side that is only looked up."""
    return group_apart(present(df.select(*keys), keys), keys)


def probe(
    rows: DataFrame, row_keys: Sequence[str], lookup: DataFrame, lookup_keys: Sequence[str], how: str
) -> DataFrame:
    """``left_semi`` / ``left_anti`` of unaggregated rows against the distinct keys of ``lookup``.

    No broadcast hint: the optimizer broadcasts the key side when its measured size allows, and
    otherwise sort-merges with skewed row partitions split.
    """
    side = lookup_side(lookup, lookup_keys)
    renamed = side.toDF(*[f"__k{i}" for i in range(len(lookup_keys))])
    condition: Column | None = None
    for i, key in enumerate(row_keys):
        part = F.col(key) == F.col(f"__k{i}")
        condition = part if condition is None else condition & part
    return rows.join(renamed, condition, how)


# Rows of one key on the right side of a left join that one task takes.
KEY_SHARE = 1_000_000


def keep_left(left: DataFrame, right: DataFrame, keys: Sequence[str], share: int = KEY_SHARE) -> DataFrame:
    """A left join that stays balanced when the *right* side has hot keys.

    Adaptive execution can only split the preserved side of an outer join. Keys are counted first; only if some have
    more than ``share`` rows on the right are these cut into shares by a hash of the whole row, and a left row is repeated
    for each; the repetitions that find nothing are dropped, because the count tells that another one does.
    Keys must not be NULL on the right; NULL keys on the left find nothing.
    """
    counts = key_counts(present(right, keys), keys, "__rows").where(F.col("__rows") > share)
    large = cut_lineage(
        counts.select(*keys, F.ceil(F.col("__rows") / share).cast("int").alias("__shares")), "hot_keys")
    if large.isEmpty():
        return left.join(right, list(keys), "left")
    ahead = left.join(large, list(keys), "left").withColumn(
        "__share", F.explode(F.sequence(F.lit(0), F.coalesce("__shares", F.lit(1)) - 1)))
    hashed = [f.name for f in right.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    own = F.pmod(F.xxhash64(*hashed), F.coalesce("__cut", F.lit(1))).cast("int")
    behind = right.join(large.withColumnRenamed("__shares", "__cut"), list(keys), "left").withColumn("__share", own).drop(
        "__cut").withColumn("__found", F.lit(True))
    joined = ahead.join(behind, [*keys, "__share"], "left")
    # A left row whose key was cut finds its partners in some shares; one whose key was not cut has a single share.
    return joined.where("__found OR __shares IS NULL").drop("__share", "__shares", "__found")
