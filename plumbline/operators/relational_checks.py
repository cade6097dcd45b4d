"""Checks that compare two tables, or a table with itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.skew import group_apart, key_counts, present, probe


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key names no parent row, one output row per child row."""
    rows = child.where(F.col(fk).isNotNull()).select(fk)
    return probe(rows, [fk], parent, [pk], "left_anti").select(
        F.col(fk).alias("record_id"), F.col(fk).alias("failed_value")
    )


def orphan_counts(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """The same finding, counted per key before any join: child rows are never shuffled whole."""
    keys = key_counts(child.where(F.col(fk).isNotNull()), [fk])
    known = present(parent.select(F.col(pk).alias(fk)), [fk]).distinct()
    return keys.join(known, fk, "left_anti")


def reconcile(
    source: DataFrame, source_date: str, source_amount: str,
    target: DataFrame, target_date: str, target_count: str, target_amount: str,
    target_filter: str | None = None,
) -> DataFrame:
    """Dates present on both sides whose row count or amount differs.

    The source is reduced to one row per date first. Equal target rows are folded into one with
    a multiplicity, so copies of one target row cost one join row; ``matches`` keeps the total.
    """
    dated = source.where(F.col(source_date).isNotNull()).select(
        F.col(source_date).alias("record_id"), F.col(source_amount).alias("__amount"))
    per_day = group_apart(
        dated, ["record_id"], F.count(F.lit(1)).alias("src_count"), F.sum("__amount").alias("src_amount"))
    rows = target.where(target_filter) if target_filter else target
    stated = (
        rows.where(F.col(target_date).isNotNull())
        .groupBy(
            F.col(target_date).alias("record_id"),
            F.col(target_count).alias("tgt_count"),
            F.col(target_amount).alias("tgt_amount"),
        )
        .agg(F.count(F.lit(1)).alias("matches"))
    )
    return (
        stated.join(per_day, "record_id")
        .where((F.col("src_count") != F.col("tgt_count")) | (F.col("src_amount") != F.col("tgt_amount")))
        .select("record_id", "src_count", "src_amount", "tgt_count", "tgt_amount", "matches")
    )


def hierarchy_findings(df: DataFrame, node: str, parent: str) -> DataFrame:
    """Rows with an unknown parent, and rows that point at each other or at themselves.

    Works on distinct (node, parent) pairs with their multiplicity; ``findings`` is the number of
    single findings a row stands for, so repeated pairs never multiply into output rows.
    """
    pairs = (
        df.where(F.col(parent).isNotNull())
        .groupBy(F.col(node).alias("record_id"), F.col(parent).alias("parent_id"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    orphaned = probe(pairs, ["parent_id"], df, [node], "left_anti").select(
        "record_id", F.lit("ORPHAN").alias("failed_value"), F.col("n").alias("findings")
    )
    mirrored = pairs.select(
        F.col("parent_id").alias("record_id"), F.col("record_id").alias("parent_id"), F.col("n").alias("m")
    )
    circular = pairs.join(mirrored, ["record_id", "parent_id"]).select(
        "record_id", F.lit("CIRCULAR").alias("failed_value"), (F.col("n") * F.col("m")).alias("findings")
    )
    return orphaned.unionByName(circular)


def repeated_tuples(
    df: DataFrame, keys: list[str], record_id: str, value: str,
    group_filter: str | None = None, row_filter: str | None = None,
) -> DataFrame:
    """Rows whose key tuple occurs several times among the rows that pass ``group_filter``."""
    grouped = df.where(group_filter) if group_filter else df
    repeated = key_counts(present(grouped, keys), keys).where("n > 1")
    rows = df.where(row_filter) if row_filter else df
    return probe(rows, keys, repeated, keys, "left_semi").select(
        F.col(record_id).alias("record_id"), F.col(value).alias("failed_value")
    )


def repeated_tuple_counts(
    df: DataFrame, keys: list[str], group_filter: str | None = None, row_filter: str | None = None
) -> DataFrame:
    """The same rows counted per tuple in one aggregation, without a join."""
    inner = F.count_if(F.expr(group_filter)) if group_filter else F.count(F.lit(1))
    outer = F.count_if(F.expr(row_filter)) if row_filter else F.count(F.lit(1))
    return (
        present(df, keys).groupBy(*keys).agg(inner.alias("in_group"), outer.alias("n"))
        .where("in_group > 1 AND n > 0")
    )


def _sides(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, na, nb): how often each value of a key occurs on either side, counted in one shuffle."""
    def side(df: DataFrame, a: int, b: int) -> DataFrame:
        filled = present(df, [key, value])
        return filled.select(key, F.col(value).alias("value"), F.lit(a).alias("a"), F.lit(b).alias("b"))

    return (
        side(left, 1, 0).unionByName(side(right, 0, 1)).groupBy(key, "value")
        .agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    )


def differing_values(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Keys of two sources whose values disagree: one row per key, with the values that differ and how many pairs do.

    Row pairs are never formed. Both sources are counted per (key, value) in one shuffle and folded per key. ``source_a_val``
    and ``source_b_val`` are the smallest value of either source, ``source_a_max`` and ``source_b_max`` the largest; for a
    key with one value on each side they agree. ``pairs`` is the number of row pairs that differ. All values of such keys
    are listed by :func:`differing_value_rows`.
    """
    folded = _sides(left, right, key, value)
    in_a, in_b = F.when(F.col("na") > 0, F.col("value")), F.when(F.col("nb") > 0, F.col("value"))
    return folded.groupBy(key).agg(
        F.min(in_a).alias("source_a_val"), F.max(in_a).alias("source_a_max"),
        F.min(in_b).alias("source_b_val"), F.max(in_b).alias("source_b_max"),
        (F.sum("na") * F.sum("nb") - F.sum(F.col("na") * F.col("nb"))).alias("pairs"),
    ).where("pairs > 0")


def differing_value_rows(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, side, value, occurrences, pairs): every value of the keys on which two sources disagree, by side.

    ``pairs`` is the number of rows of the other source that differ from it, so no value and no difference is lost and
    still no pair is formed. Totals per key are joined back to its values, so a key with very many values stays spread.
    """
    counted = _sides(left, right, key, value)
    totals = group_apart(counted, [key], F.sum("na").alias("ta"), F.sum("nb").alias("tb")).where("ta > 0 AND tb > 0")
    each = counted.join(totals, key).select(key, "value", F.inline(F.array(
        F.struct(F.lit("A").alias("side"), F.col("na").alias("occurrences"), (F.col("tb") - F.col("nb")).alias("pairs")),
        F.struct(F.lit("B").alias("side"), F.col("nb").alias("occurrences"), (F.col("ta") - F.col("na")).alias("pairs")))))
    return each.where("occurrences > 0 AND pairs > 0").select(key, "side", "value", "occurrences", "pairs")


def table_checksum(df: DataFrame, columns: list[str], amounts: list[str]) -> DataFrame:
    """Row count, sums and an order-free checksum in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.sum(c).alias(f"sum_{c}") for c in amounts],
        F.bit_xor(F.xxhash64(*columns)).alias("checksum"),
        F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("hash_sum"),
    )


def checksum_reconciliation(
    source: DataFrame, target: DataFrame, columns: list[str], amounts: list[str]
) -> DataFrame:
    """Both sides' metrics in two rows, and whether all of them agree.

    The exclusive-or cancels rows that occur an even number of times, so the sum of hashes is
    compared as well.
    """
    sides = table_checksum(source, columns, amounts).withColumn("side", F.lit("source")).unionByName(
        table_checksum(target, columns, amounts).withColumn("side", F.lit("target"))
    )
    metrics = ["row_count", *[f"sum_{c}" for c in amounts], "checksum", "hash_sum"]
    return sides.groupBy().agg(
        *[F.max(F.when(F.col("side") == s, F.col(m))).alias(f"{s}_{m}")
          for s in ("source", "target") for m in metrics],
    ).withColumn(
        "matches",
        F.forall(
            F.array(*[F.col(f"source_{m}").eqNullSafe(F.col(f"target_{m}")) for m in metrics]),
            lambda same: same,
        ),
    )
