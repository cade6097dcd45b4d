"""What the next scheduled step has to work on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.predicates import as_of_column
from plumbline.operators.skew import probe
from plumbline.plans.remediation import EXPLANATION

WINDOW_HOURS = 2


def monitored_tables(assignments: DataFrame) -> DataFrame:
    """Qualified names of the tables with an active check."""
    name = F.concat_ws(".", "target_database", "target_schema", "target_table")
    return assignments.where("is_active").select(name.alias("table_fqn")).distinct()


def _recent(run_log: DataFrame, as_of: dt.datetime, hours: int) -> DataFrame:
    start = as_of_column(as_of - dt.timedelta(hours=hours))
    return run_log.where(F.col("run_start_time") >= start)


def unscored_runs(run_log: DataFrame, scores: DataFrame, as_of: dt.datetime, hours: int = WINDOW_HOURS) -> DataFrame:
    return probe(_recent(run_log, as_of, hours).select("run_id"), ["run_id"], scores, ["run_id"], "left_anti")


def unexplained_runs(run_log: DataFrame, cache: DataFrame, as_of: dt.datetime, hours: int = WINDOW_HOURS) -> DataFrame:
    explained = cache.where(F.col("analysis_type") == EXPLANATION).select("run_id")
    failed = _recent(run_log, as_of, hours).where("failed_checks > 0").select("run_id")
    return probe(failed, ["run_id"], explained, ["run_id"], "left_anti")
