"""Group checks over arriving data, with state that leaves.

An endless table has no whole groups, so a group is what arrives under one key within some time: every pair of its rows at
most ``span`` apart is in one window of twice that length, and every row in two such windows. Checks 2, 3, 19 and the duplicate
form of 25 all ask how often a key occurs, so one aggregation counts for all of them.

A window is kept until the watermark, ``delay`` behind the newest moment seen, has passed its end; then it leaves the state.
Rows that come later than that find no window: they are not judged, and ``late_rows`` tells how many they were. Rows
without a moment belong to no window. A finding is told as soon as its count is reached and again whenever it grows, so
of a group's findings the one with the largest count stands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.config.specs import CheckSpec
from plumbline.frames import literal_frame
from plumbline.functions.scoring import check_status
from plumbline.operators.skew import KEPT_TEXT
from plumbline.schemas import columns
from plumbline.session import setting
from plumbline.streaming.feeds import write_batches

GROUPED = {2, 3, 19, 25}
# Groups wait on disk, so that the memory of an executor does not follow their number.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _names(text: str) -> list[str]:
    return [name.strip() for name in text.split(",")]


def _entry(number: int, spec: CheckSpec) -> Column:
    """What a row counts for in one check: the group it is in, and whether it makes the group and is counted itself."""
    made, counted = F.lit(True), F.lit(True)
    present = False
    if spec.check_id == 2:
        keys = [spec.column()]
    elif spec.check_id == 3:
        keys = _names(spec.param("columns"))
        where = spec.params.get("where_clause", "").strip()
        where = where[6:] if where.upper().startswith("WHERE ") else where
        made = F.expr(where) if where else made
    elif spec.check_id == 19:
        keys, present = [spec.param("file_column")], True
    elif spec.check_id == 25 and "duplicate_keys" in spec.params:
        keys, present = _names(spec.param("duplicate_keys")), True
        made = F.expr(spec.params["group_filter"]) if spec.params.get("group_filter") else made
        counted = F.expr(spec.params["row_filter"]) if spec.params.get("row_filter") else counted
    else:
        raise ValueError(f"no group check: {spec.label}")
    if present:
        for key in keys:
            made, counted = made & F.col(key).isNotNull(), counted & F.col(key).isNotNull()
    if spec.check_id == 3:
        counted = made
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    name = F.when(F.length(name) > KEPT_TEXT, F.concat(F.lit("#"), F.sha2(name, 256))).otherwise(name)
    return F.struct(
        F.lit(number).alias("check_number"), name.alias("group_key"), F.coalesce(made, F.lit(False)).alias("made"),
        F.coalesce(counted, F.lit(False)).alias("counted"))


def group_counts(
    rows: DataFrame, specs: list[CheckSpec], time_column: str, span: str, delay: str | None = None
) -> DataFrame:
    """(window_start, check_number, group_key, occurrences, failing) of the groups that fail, of a table or a stream.

    ``span`` and ``delay`` are intervals such as ``1 day``; ``delay`` is the watermark of a stream.
    """
    moment = rows.withColumn("__at", F.col(time_column).cast("timestamp"))
    if delay is not None:
        moment = moment.withWatermark("__at", delay)
    entries = F.array(*[_entry(i, s) for i, s in enumerate(specs)])
    each = moment.select("__at", F.explode(entries).alias("e")).where("__at IS NOT NULL AND (e.made OR e.counted)")
    length = F.window("__at", f"{_doubled(span)}", span)
    grouped = each.groupBy(length.alias("w"), F.col("e.check_number").alias("check_number"), F.col("e.group_key").alias("group_key"))
    return grouped.agg(F.count_if("e.made").alias("occurrences"), F.count_if("e.counted").alias("failing")).where(
        "occurrences > 1 AND failing > 0").select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), "check_number", "group_key", "occurrences", "failing")


def _doubled(span: str) -> str:
    count, unit = span.split()
    return f"{2 * int(count)} {unit}"


def check_groups(
    stream: DataFrame, specs: list[CheckSpec], time_column: str, span: str, delay: str, path: str, checkpoint: str,
    trigger=None,
) -> StreamingQuery:
    """Look for failing groups in every micro-batch; a batch tells the groups that fail since it or have grown."""
    refused = [s.label for s in specs if s.check_id not in GROUPED]
    if refused:
        raise ValueError(f"no group checks: {refused}")
    counts = group_counts(stream, specs, time_column, span, delay)
    spark = stream.sparkSession
    with setting(spark, "spark.sql.streaming.stateStore.providerClass", STATE_STORE), setting(
            spark, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true"):
        return write_batches(counts, lambda batch: batch, path, checkpoint, "update", trigger)


def standing(findings: DataFrame) -> DataFrame:
    """Each failing group once, as it was told last; counts only grow."""
    return findings.groupBy("window_start", "check_number", "group_key").agg(
        F.max("occurrences").alias("occurrences"), F.max("failing").alias("failing"))


def group_results(findings: DataFrame, specs: list[CheckSpec]) -> DataFrame:
    """One row per check: failing groups, or for check 25 failing rows, and the status by its limits.

    A group counts once however many windows it fails in, with the most rows of a window.
    """
    once = standing(findings).groupBy("check_number", "group_key").agg(F.max("failing").alias("failing"))
    counted = once.groupBy("check_number").agg(F.count(F.lit(1)).alias("groups"), F.sum("failing").alias("rows"))
    listed = literal_frame(findings.sparkSession, [
        (i, s.check_id, s.target_column, s.warning, s.fail) for i, s in enumerate(specs)], columns(
        "check_number bigint, check_id bigint, target_column string, warning decimal(10,4), fail decimal(10,4)"))
    count = F.coalesce(F.when(F.col("check_id") == 25, F.col("rows")).otherwise(F.col("groups")), F.lit(0))
    return listed.join(counted, "check_number", "left").select(
        "check_id", "target_column", count.alias("failure_count"), check_status(count, F.col("warning"), F.col("fail")).alias("check_status"))


def late_rows(query: StreamingQuery) -> int:
    """Rows that came after their windows had left, once for each window, as far as the query's progress goes back."""
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
