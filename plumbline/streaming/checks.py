"""Row checks over arriving data.

Row predicates need no state. Group checks would need state without a bound, since arriving data
carries no promise about when a key is complete; they run in batch only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.config.specs import CheckSpec
from plumbline.plans.binding import RowCheck, TableContext
from plumbline.plans.engine import check_results, plan_table
from plumbline.sources.tables import Tables
from plumbline.streaming.feeds import write_batches

STATELESS = {1, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 20, 21, 24, 25}


def check_batches(
    spark: SparkSession, stream: DataFrame, table: str, specs: list[CheckSpec], as_of: dt.datetime,
    path: str, checkpoint: str,
) -> StreamingQuery:
    """Check every micro-batch; results are keyed by batch."""
    refused = [s.label for s in specs if s.check_id not in STATELESS]
    if refused:
        raise ValueError(f"only row checks can run on a stream, not {refused}")

    def results(batch: DataFrame) -> DataFrame:
        plan = plan_table(TableContext(Tables(spark, {table: batch}), table, as_of), specs)
        if any(not isinstance(check, RowCheck) for check in plan.bound):
            raise ValueError("only row checks can run on a stream")
        return check_results(plan)

    return write_batches(stream, results, path, checkpoint)
