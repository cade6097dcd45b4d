"""Change feeds: streams over the change logs of result tables, with exactly-once batch outputs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.text import classify_safety
from plumbline.operators.delta import AFTER, INSERT
from plumbline.operators.schema_checks import drift_summary


def write_batches(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    output_mode: str = "append", trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Apply a batch transform to each micro-batch.

    ``trigger`` takes what ``DataStreamWriter.trigger`` does; by default all that is there is read and the query ends.

    Every batch owns one folder of the output and overwrites it, so a batch that is repeated after
    a failure leaves no duplicates.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(output_mode).foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def new_state(changes: DataFrame) -> DataFrame:
    """Of a change log, the rows that were added or changed, as they are now; other frames as they are."""
    if "change_type" not in changes.columns:
        return changes
    return changes.where(F.col("change_type").isin(INSERT, AFTER))


def result_feed(results: DataFrame) -> DataFrame:
    """New results, and results that changed, that did not pass."""
    return new_state(results).where("check_status <> 'PASS'")


def drift_feed(columns: DataFrame, snapshots: Callable[[], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Drift of the current schemas of the tables that a batch of new snapshots concerns.

    The batch only tells which tables; they are compared with the stored ``snapshots``, so that a snapshot which is
    spread over several batches is seen whole.
    """
    def report(batch: DataFrame) -> DataFrame:
        keys = ["table_schema", "table_name"]
        tables = batch.select(*keys).distinct()
        return drift_summary(columns.join(tables, keys, "left_semi"), snapshots().join(tables, keys, "left_semi"))

    return report


def recommendation_feed(recommendations: DataFrame) -> DataFrame:
    return new_state(recommendations).withColumn(
        "safety_classification", classify_safety(F.col("recommendation_text"))
    )


def audit_status_counts(audit: DataFrame) -> DataFrame:
    """Running count per status; the state holds one row per status.

    Of a change log, rows that were taken away or had another status before are subtracted.
    """
    if "change_type" not in audit.columns:
        return audit.groupBy("status").agg(F.count(F.lit(1)).alias("executions"))
    sign = F.when(F.col("change_type").isin(INSERT, AFTER), F.col("change_count")).otherwise(-F.col("change_count"))
    return audit.groupBy("status").agg(F.sum(sign).alias("executions"))
