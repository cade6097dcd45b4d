"""Schema metadata as frames, and drift between two schemas."""

from __future__ import annotations

import datetime as dt
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.frames import literal_frame
from plumbline.functions.predicates import as_of_column
from plumbline.schemas import columns
from plumbline.session import cut_lineage

COLUMN_METADATA = columns(
    "table_catalog string, table_schema string, table_name string, column_name string, "
    "ordinal_position bigint, data_type string, character_maximum_length bigint, "
    "numeric_precision bigint, numeric_scale bigint, is_nullable string"
)

OFFSETS = T.StructType().add("__range", "integer").add("__before", "long")


def schema_frame(
    spark: SparkSession, schema: T.StructType, table: str, catalog: str = "main", namespace: str = "public"
) -> DataFrame:
    """One row per column; the data type carries no length or precision."""
    rows = []
    for position, field in enumerate(schema.fields, start=1):
        kind = field.dataType
        decimal = isinstance(kind, T.DecimalType)
        sized = isinstance(kind, (T.VarcharType, T.CharType))
        rows.append((
            catalog, namespace, table, field.name, position, kind.typeName(),
            kind.length if sized else None,
            kind.precision if decimal else None, kind.scale if decimal else None,
            "YES" if field.nullable else "NO",
        ))
    return literal_frame(spark, rows, COLUMN_METADATA)


def schema_listing(listing: DataFrame) -> DataFrame:
    return listing.orderBy("ordinal_position")


def schema_snapshot(columns: DataFrame, snapshots: DataFrame | None, taken_at: dt.datetime) -> DataFrame:
    """Rows to append to the snapshot table; ids continue after the largest one, table by table.

    Rows are dealt by ranges of their order and written once; only the number of rows of each range, one number per
    partition however many tables there are, reaches the driver.
    """
    start = F.lit(0)
    if snapshots is not None:
        start = snapshots.agg(F.coalesce(F.max("snapshot_id"), F.lit(0)).alias("m")).scalar()
    order = ["table_name", "table_schema", "table_catalog", "ordinal_position", "column_name"]
    dealt = cut_lineage(columns.select(*COLUMN_METADATA.fieldNames()).repartitionByRange(*order).withColumn(
        "__range", F.spark_partition_id()), "listing")
    sizes = dealt.groupBy("__range").count().orderBy("__range").collect()
    before = accumulate((r["count"] for r in sizes), initial=0)
    offsets = literal_frame(columns.sparkSession, [(r["__range"], n) for r, n in zip(sizes, before)], OFFSETS)
    numbered = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn("__place", numbered).join(offsets, "__range").select(
        (start + F.col("__before") + F.col("__place")).cast("bigint").alias("snapshot_id"),
        *COLUMN_METADATA.fieldNames(), as_of_column(taken_at).alias("snapshot_at"),
    )


# Copies of a change that one generated list holds.
COPIES_AT_ONCE = 1000


def changed_columns(listing: DataFrame, snapshots: DataFrame, table: str | None = None) -> DataFrame:
    """Columns absent from *every* snapshot of their table, and snapshot columns absent now.

    A removed column shows once per snapshot that still has it. Without a table name all tables
    are compared. Both sides are read once and counted by column in one shuffle; nothing is sorted. Nearly every column is
    its own group, so rows are dealt before they are counted, into all shuffle partitions: small ones merged to a few would
    have to hold all their groups at once. An absent name equals no other, so such rows are counted by side.
    """
    keys = ["table_name", "column_name"]
    sides = listing.select(*keys, F.lit("ADDED").alias("side")).unionByName(
        snapshots.select(*keys, F.lit("REMOVED").alias("side")))
    if table is not None:
        sides = sides.where(F.col("table_name") == table)
    apart = F.when(F.col("table_name").isNull() | F.col("column_name").isNull(), F.col("side"))
    partitions = int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = sides.repartition(partitions, *keys).groupBy(*keys, apart.alias("apart")).agg(
        F.count_if(F.col("side") == "ADDED").alias("added"), F.count_if(F.col("side") == "REMOVED").alias("removed"))
    n = F.col("added") + F.col("removed")
    changed = counted.where("added = 0 OR removed = 0").select(
        *keys, F.when(F.col("added") > 0, "ADDED").otherwise("REMOVED").alias("failed_value"), n.alias("n"),
        F.explode(F.sequence(F.lit(1).cast("long"), n, F.lit(COPIES_AT_ONCE).cast("long"))).alias("first"))
    times = F.least(F.lit(COPIES_AT_ONCE), F.col("n") - F.col("first") + 1).cast("int")
    return changed.withColumn("failed_value", F.explode(F.array_repeat("failed_value", times))).select(
        "table_name", F.col("column_name").alias("record_id"), "failed_value")


TABLE = ["table_schema", "table_name"]


def latest_baseline(snapshots: DataFrame) -> DataFrame:
    """Columns of the newest snapshot of each table, each once however often that snapshot was stored."""
    order = F.struct("snapshot_at", *[c for c in ("snapshot_id",) if c in snapshots.columns])
    newest = snapshots.groupBy(*TABLE, "column_name").agg(
        F.max_by("data_type", order).alias("data_type"), F.max_by("ordinal_position", order).alias("ordinal_position"),
        F.max("snapshot_at").alias("snapshot_at"))
    return newest.withColumn("__newest", F.max("snapshot_at").over(Window.partitionBy(*TABLE))).where(
        "snapshot_at = __newest").drop("__newest")


def _compared(columns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Current and baseline columns side by side; ``drift`` tells what changed, if anything did."""
    base = latest_baseline(snapshots).select(
        *TABLE, "column_name", F.col("data_type").alias("old_type"), F.col("ordinal_position").alias("old_position"),
        F.col("snapshot_at").alias("baseline_at"), F.lit(True).alias("was"),
    )
    now = columns.select(
        *TABLE, "column_name", F.col("data_type").alias("new_type"), F.col("ordinal_position").alias("new_position"),
        F.lit(True).alias("is"),
    )
    drift = (
        F.when(F.col("was").isNull(), "ADDED").when(F.col("is").isNull(), "REMOVED")
        .when(F.col("old_type") != F.col("new_type"), "TYPE_CHANGED")
    )
    return (
        now.join(base, [*TABLE, "column_name"], "full_outer").withColumn("drift", drift)
        .withColumn("drift_order", F.array_position(
            F.array(F.lit("ADDED"), F.lit("REMOVED"), F.lit("TYPE_CHANGED")), F.col("drift")))
        .withColumn("position", F.coalesce("new_position", "old_position"))
    )


def drift(columns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Added, removed and retyped columns against the latest snapshot, for all tables at once.

    Tables without any snapshot do not appear; see :func:`drift_summary`.
    """
    known = F.max("baseline_at").over(Window.partitionBy(*TABLE))
    return (
        _compared(columns, snapshots).withColumn("known", known).where("known IS NOT NULL AND drift IS NOT NULL")
        .select(*TABLE, "drift", "drift_order", "column_name", "position", "old_type", "new_type")
    )


def drift_summary(columns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row per current table: status, number of changes and the changes in order."""
    entry = F.struct("drift_order", "position", "column_name", "drift")
    compared = _compared(columns, snapshots).groupBy(*TABLE).agg(
        F.max("baseline_at").alias("baseline_at"), F.max("is").alias("present"),
        F.array_sort(F.collect_list(F.when(F.col("drift").isNotNull(), entry))).alias("changes"),
    ).where("present")
    known = F.col("baseline_at").isNotNull()
    count = F.when(known, F.size("changes")).otherwise(0).cast("bigint")
    listed = F.array_join(F.transform("changes", lambda e: F.concat_ws(":", e["drift"], e["column_name"])), ", ")
    return compared.select(
        *TABLE, "baseline_at",
        F.when(~known, "NO_BASELINE").when(count > 0, "DRIFT_DETECTED").otherwise("NO_DRIFT").alias("status"),
        count.alias("drift_count"), F.when(known, listed).otherwise("").alias("drift_list"),
    )


def renamed_columns(columns: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Removed and added columns of one table that share type and position."""
    changes = drift(columns, snapshots)
    gone = changes.where("drift = 'REMOVED'").select(
        "table_schema", "table_name", "position",
        F.col("old_type").alias("data_type"), F.col("column_name").alias("old_name"),
    )
    new = changes.where("drift = 'ADDED'").select(
        "table_schema", "table_name", "position",
        F.col("new_type").alias("data_type"), F.col("column_name").alias("new_name"),
    )
    return gone.join(new, ["table_schema", "table_name", "position", "data_type"])
