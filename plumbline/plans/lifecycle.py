"""From runs and profiles to stored results, scores and views."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config.specs import CheckSpec
from plumbline.functions.predicates import as_of_column
from plumbline.operators.schema_checks import schema_frame, schema_snapshot
from plumbline.plans import health, incremental, profiling, remediation
from plumbline.plans.binding import TableContext
from plumbline.plans.engine import FullRun, run_all
from plumbline.session import cut_lineage
from plumbline.sources.store import ResultStore


def run_and_store(
    spark: SparkSession, store: ResultStore, contexts: Iterable[TableContext], specs: Iterable[CheckSpec]
) -> FullRun:
    """Run every table and store the outcome.

    Run ids follow from database, schema, table and moment, so that a run that is repeated replaces what it wrote
    before, also where it finds less now. The run log is written last: a run that appears there
    is complete.
    """
    run = run_all(spark, contexts, specs)
    runs = run.run_log.select("run_id", F.col("run_start_time").alias("created_at"))
    store.replace_runs("check_results", run.results, runs)
    store.replace_runs("failed_records", run.failed_records, runs)
    store.replace_runs("run_log", run.run_log)
    return run


def score_new_runs(store: ResultStore, as_of: dt.datetime, hours: int = incremental.WINDOW_HOURS) -> DataFrame:
    """Score the recent runs that have none yet; returns the new scores."""
    since = as_of - dt.timedelta(hours=hours)
    recent = store.read("run_log", since)
    runs = incremental.unscored_runs(recent, store.read("health_scores", since), as_of, hours)
    results = store.read("check_results", since).join(runs, "run_id", "left_semi")
    scores = cut_lineage(health.health_scores(results, as_of_column(as_of)), "scores")
    store.replace_runs("health_scores", scores)
    return scores


def rerun_and_compare(
    spark: SparkSession, store: ResultStore, contexts: Iterable[TableContext], specs: Iterable[CheckSpec],
    as_of: dt.datetime,
) -> DataFrame:
    """Run and score everything again at ``as_of`` and compare with the scored runs before it."""
    again = [TableContext(c.tables, c.table, as_of, c.snapshots, c.catalog, c.namespace) for c in contexts]
    before = store.read("run_log").selectExpr("MAX(run_start_time) AS m").first().m
    run_and_store(spark, store, again, specs)
    score_new_runs(store, as_of)
    return health.score_changes(store.read("health_scores"), store.read("run_log"), as_of_column(before))


def profile_and_store(store: ResultStore, ctx: TableContext) -> DataFrame:
    """Profile one table, store its profiles, distributions and schema; returns the receipt.

    A profile of the same table and moment takes the place of an earlier one.
    """
    moment, names = ctx.as_of, {"catalog": ctx.catalog, "namespace": ctx.namespace}
    columns = schema_frame(store.spark, ctx.df.schema, ctx.table, ctx.catalog, ctx.namespace)
    profile = profiling.table_profile(ctx.df, ctx.table, moment, **names)
    counts = profiling.value_counts_of(ctx.df)
    store.replace("column_profiles", profiling.located(
        profiling.column_profiles(ctx.df, counts=counts), ctx.table, moment, "profiled_at", **names))
    store.replace("distribution_snapshots", profiling.located(
        profiling.distributions(ctx.df, counts=counts), ctx.table, moment, "snapshot_at", **names))
    snapshot = cut_lineage(schema_snapshot(columns, store.read("schema_snapshots"), moment), "snapshot")
    store.replace("schema_snapshots", snapshot)
    store.replace("table_profiles", profile)
    return profiling.profile_receipt(profile)


def register_views(store: ResultStore, library: DataFrame) -> list[str]:
    """The readable objects over a store as temporary views; returns their names."""
    log, results = store.read("run_log"), store.read("check_results")
    scores, failed = store.read("health_scores"), store.read("failed_records")
    replies = store.read("analysis_cache"), store.read("approval_queue"), store.read("remediation_audit")
    views = {
        "dq_run_log": log,
        "dq_check_library": library,
        "v_check_summary": health.check_summary(results, log),
        "v_table_health_dashboard": health.table_health(scores, log, failed),
        "v_overall_health": health.overall_health(scores, log, failed),
        "ai_analysis_cache": replies[0],
        "v_pending_remediations": remediation.pending_remediations(*replies),
        "v_remediation_history": remediation.remediation_history(*replies),
        **{t: store.read(t) for t in ("table_profiles", "column_profiles", "distribution_snapshots")},
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
