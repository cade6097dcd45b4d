"""Statistical checks: one pass for the statistics, one for the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.frames import literal_frame
from plumbline.operators.quantiles import exact_quantiles
from plumbline.session import cut_lineage


def _spread(df: DataFrame, column: str) -> Column:
    """Mean and sample deviation as one scalar subquery, shared by all its uses."""
    value = F.col(column).cast("double")
    return df.agg(F.struct(F.avg(value).alias("mean"), F.stddev_samp(value).alias("dev")).alias("s")).scalar()


def zscore(df: DataFrame, column: str) -> Column:
    spread = _spread(df, column)
    return (F.col(column).cast("double") - spread["mean"]) / F.nullif(spread["dev"], F.lit(0.0))


def outliers(df: DataFrame, column: str, record_id: str, limit: float) -> DataFrame:
    """Rows further than ``limit`` deviations from the mean, with their signed score."""
    score = zscore(df, column)
    return df.where(F.col(column).isNotNull() & (F.abs(score) > limit)).select(
        F.col(record_id).alias("record_id"), F.col(column).alias("failed_value"),
        F.round(score, 2).alias("z_score"),
    )


def outlier_distances(df: DataFrame, column: str, limit: float) -> DataFrame:
    """The unsigned form: value and distance in deviations."""
    score = F.abs(zscore(df, column))
    return df.where(score > limit).select(F.col(column), score.alias("z_score"))


def interquartile_outliers(df: DataFrame, column: str, record_id: str, whisker: float = 1.5) -> DataFrame:
    """Rows outside the quartiles by more than ``whisker`` interquartile ranges."""
    quartiles = exact_quantiles(df, {column: [0.25, 0.75]})[column]
    if None in quartiles:
        return df.where(F.lit(False)).select(
            F.col(record_id).alias("record_id"), F.col(column).alias("failed_value")
        )
    low, high = (float(q) for q in quartiles)
    reach = whisker * (high - low)
    return df.where((F.col(column) < low - reach) | (F.col(column) > high + reach)).select(
        F.col(record_id).alias("record_id"), F.col(column).alias("failed_value")
    )


def largest_gap(current: DataFrame, baseline: DataFrame, column: str, level: float = 1.36) -> DataFrame:
    """How far two samples of numbers are apart: the largest difference of their distributions (Kolmogorov-Smirnov).

    One row: n_now, n_base, distance (0 to 1), at_value, the smallest value where it is reached, the distance that ``level``
    allows for samples of these sizes, and whether it is exceeded. Values are counted first; the counts are dealt by ranges
    of values and added up within each range, and what lies before a range is one number for each. Nulls take no part; an
    empty sample gives no distance.
    """
    rows = None
    for df, a, b in ((current, 1, 0), (baseline, 0, 1)):
        part = df.select(F.col(column).alias("v"), F.lit(a).alias("a"), F.lit(b).alias("b")).where("v IS NOT NULL")
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    placed = cut_lineage(counts.repartitionByRange("v").sortWithinPartitions("v").select(
        "v", "a", "b", F.monotonically_increasing_id().alias("row")), "ranges").withColumn("part", F.shiftright("row", 33))
    # One row for each range: as many as partitions.
    sizes = placed.groupBy("part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("part").collect()
    before, n, m = [], 0, 0
    for r in sizes:
        before.append((r.part, n, m))
        n, m = n + r.a, m + r.b
    starts = literal_frame(placed.sparkSession, before, T.StructType().add("part", "long").add("a0", "long").add("b0", "long"))
    so_far = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    summed = placed.select("part", "v", F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"))
    gap = F.abs((F.col("a") + F.col("a0")) / F.nullif(F.lit(n).cast("double"), F.lit(0.0))
                - (F.col("b") + F.col("b0")) / F.nullif(F.lit(m).cast("double"), F.lit(0.0)))
    widest = summed.join(starts, "part").select(gap.alias("distance"), "v").agg(
        F.max("distance").alias("distance"), F.min_by("v", F.struct(-F.col("distance"), F.col("v"))).alias("at_value"))
    allowed = F.lit(level * ((n + m) / (n * m)) ** 0.5 if n and m else None).cast("double")
    return widest.select(
        F.lit(n).cast("long").alias("n_now"), F.lit(m).cast("long").alias("n_base"), "distance",
        F.when(F.col("distance").isNotNull(), F.col("at_value")).alias("at_value"), allowed.alias("allowed"),
        (F.col("distance") > allowed).alias("shifted"))
