"""Runs many checks over a table in few scans.

All row checks of a table are one aggregate over one scan; their samples are one more scan.
Group checks share a shuffle where their keys coincide.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import logging
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.logger import PySparkLogger
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline import schemas
from plumbline.config.specs import CheckSpec
from plumbline.functions.predicates import as_of_column
from plumbline.functions.scoring import check_status, failure_fraction
from plumbline.plans.binding import FrameCheck, KeyedCheck, RowCheck, TableContext, bind, grouped
from plumbline.session import scratch_path
from plumbline.sources.tables import Tables

SAMPLES_PER_CHECK = 100
# Parts in which the findings of one check are cut to the limit before they meet.
SAMPLE_SHARES = 512
ERROR_LENGTH = 1990

Bound = RowCheck | KeyedCheck | FrameCheck


def run_identifier(ctx: TableContext) -> str:
    """The same table and moment give the same id, so that a repeated run replaces its rows."""
    parts = [ctx.catalog, ctx.namespace, ctx.table, ctx.as_of.isoformat()]
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()[:36]


def specs_of(ctx: TableContext, specs: Iterable[CheckSpec]) -> list[CheckSpec]:
    """The specifications for this table: database, schema and table must agree, whatever their case."""
    name = tuple(n.lower() for n in (ctx.catalog, ctx.namespace, ctx.table))
    return [s for s in specs if tuple(n.lower() for n in (s.target_database, s.target_schema, s.target_table)) == name]


def contexts_of(
    specs: Iterable[CheckSpec], tables: Callable[[str, str], Tables], as_of: dt.datetime,
    snapshots: DataFrame | None = None,
) -> list[TableContext]:
    """One context for each table that the specifications name.

    ``tables`` gives the tables of a database and schema. Names that differ in case only are one table.
    """
    named = {}
    for s in specs:
        name = (s.target_database, s.target_schema, s.target_table)
        named.setdefault(tuple(n.lower() for n in name), name)
    return [
        TableContext(tables(database, schema), table, as_of, snapshots, database, schema)
        for _, (database, schema, table) in sorted(named.items())
    ]


@dataclass
class TablePlan:
    ctx: TableContext
    run_id: str
    bound: list[Bound]
    errors: list[tuple[CheckSpec, str]] = field(default_factory=list)


def plan_table(ctx: TableContext, specs: Iterable[CheckSpec], run_id: str | None = None) -> TablePlan:
    """Bind every check by itself: one that cannot be analysed becomes an ERROR row, the rest run."""
    plan = TablePlan(ctx, run_id or run_identifier(ctx), [])
    with _expected_errors():
        for spec in specs:
            try:
                plan.bound.append(bind(spec, ctx))
            except (PySparkException, KeyError, ValueError) as error:
                plan.errors.append((spec, str(error)[:ERROR_LENGTH]))
    return plan


@contextmanager
def _expected_errors():
    """Keep the stack traces of checks that cannot be analysed out of the log; they become rows."""
    log = PySparkLogger.getLogger("DataFrameQueryContextLogger")
    level = log.level
    log.setLevel(logging.CRITICAL)
    try:
        yield
    finally:
        log.setLevel(level)


def _described(spec: CheckSpec, count: Column, total: Column, error: str | None = None) -> Column:
    return F.struct(
        F.lit(spec.label).alias("label"),
        F.lit(spec.check_id).cast("bigint").alias("check_id"),
        F.lit(spec.check_name).alias("check_name"),
        F.lit(spec.target_column).cast("string").alias("target_column"),
        total.cast("bigint").alias("total_rows"),
        count.cast("bigint").alias("failure_count"),
        F.lit(spec.warning).cast("decimal(10,4)").alias("threshold_warning"),
        F.lit(spec.fail).cast("decimal(10,4)").alias("threshold_fail"),
        F.lit(spec.severity).alias("severity"),
        F.lit(spec.weight).cast("decimal(5,2)").alias("weight"),
        F.lit(error).cast("string").alias("error_message"),
    )


def _keyed_sets(bound: list[Bound]) -> list[list[KeyedCheck]]:
    sets: dict[tuple, list[KeyedCheck]] = {}
    for check in bound:
        if isinstance(check, KeyedCheck):
            sets.setdefault((check.keys, check.where), []).append(check)
    return list(sets.values())


def _counts(plan: TablePlan) -> DataFrame:
    df, total = plan.ctx.df, plan.ctx.total()
    rows = [c for c in plan.bound if isinstance(c, RowCheck)]
    parts: list[DataFrame] = []
    if rows or plan.errors:
        fused = df.agg(
            F.count(F.lit(1)).alias("total"),
            *[F.count_if(c.predicate).alias(f"c{i}") for i, c in enumerate(rows)],
        )
        described = [_described(c.spec, F.col(f"c{i}"), F.col("total")) for i, c in enumerate(rows)]
        described += [_described(s, F.lit(0), F.col("total"), message) for s, message in plan.errors]
        parts.append(fused.select(F.inline(F.array(*described))))
    for checks in _keyed_sets(plan.bound):
        tested = grouped(df, checks, compact=True).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("grouped_rows"),
            *[F.count_if(c.test).alias(f"c{i}") for i, c in enumerate(checks)],
        )
        rows_seen = total if checks[0].where else F.col("grouped_rows")
        parts.append(tested.select(F.inline(F.array(*[
            _described(c.spec, F.col(f"c{i}"), rows_seen) for i, c in enumerate(checks)
        ]))))
    for check in plan.bound:
        if isinstance(check, FrameCheck):
            one = _described(check.spec, F.col("failure_count"), total)
            parts.append(check.counts.select(F.inline(F.array(one))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def check_results(plan: TablePlan) -> DataFrame:
    """One row per check of the table, none without checks; nothing runs before an action."""
    if not plan.bound and not plan.errors:
        return plan.ctx.tables.spark.createDataFrame([], schemas.CHECK_RESULTS)
    return _labelled_results(plan).drop("label")


def _labelled_results(plan: TablePlan) -> DataFrame:
    counted = _counts(plan)
    failed = F.col("error_message").isNotNull()
    status = F.when(failed, "ERROR").otherwise(
        check_status(F.col("failure_count"), F.col("threshold_warning"), F.col("threshold_fail"))
    )
    return counted.select(
        "label",
        F.sha2(F.concat_ws("|", F.lit(plan.run_id), "label"), 256).substr(1, 36).alias("result_id"),
        F.lit(plan.run_id).alias("run_id"),
        "check_id", "check_name",
        F.lit(plan.ctx.table).alias("target_table"),
        "target_column",
        status.alias("check_status"),
        "total_rows", "failure_count",
        failure_fraction(F.col("failure_count"), F.col("total_rows")).alias("failure_pct"),
        "threshold_warning", "threshold_fail", "severity", "weight",
        F.lit(None).cast("decimal(5,2)").alias("score"),
        F.lit(None).cast("bigint").alias("execution_time_ms"),
        "error_message",
        as_of_column(plan.ctx.as_of).alias("created_at"),
    )


def _sample_columns(spec: CheckSpec, record: Column, value: Column) -> list[Column]:
    return [
        F.lit(spec.label).alias("label"),
        F.lit(spec.check_id).cast("bigint").alias("check_id"),
        F.lit(spec.target_column or "N/A").alias("column_name"),
        F.lit(spec.check_name).alias("failure_reason"),
        F.coalesce(record.cast("string"), F.lit("N/A")).alias("record_identifier"),
        F.coalesce(value.cast("string"), F.lit("N/A")).alias("failed_value"),
    ]


def without_passed(plan: TablePlan, failing: set[str]) -> TablePlan:
    """The plan reduced to the checks with these labels: passed ones have nothing to sample."""
    return TablePlan(plan.ctx, plan.run_id, [c for c in plan.bound if c.spec.label in failing])


def failed_records(plan: TablePlan, limit: int = SAMPLES_PER_CHECK) -> DataFrame:
    """Up to ``limit`` failing records per check, the smallest identifiers first.

    Row checks share one pass: every row carries the findings it caused, rows without any vanish
    in the generator. The per-check limit is applied inside each task before the shuffle, then per
    share of a check's findings and then per check, so that no task sees what all tasks hand over.
    """
    df = plan.ctx.df
    rows = [c for c in plan.bound if isinstance(c, RowCheck)]
    parts: list[DataFrame] = []
    if rows:
        hits = F.array_compact(F.array(*[
            F.when(c.predicate, F.struct(*_sample_columns(c.spec, c.record, c.value))) for c in rows
        ]))
        parts.append(df.select(F.inline(hits)).withColumn("copies", F.lit(1).cast("bigint")))
    for checks in _keyed_sets(plan.bound):
        for c in checks:
            if c.record is not None:
                parts.append(grouped(df, checks).where(c.test).select(
                    *_sample_columns(c.spec, c.record, c.value), F.lit(1).cast("bigint").alias("copies")))
    for c in plan.bound:
        if isinstance(c, FrameCheck) and c.failing is not None:
            parts.append(c.failing.select(
                *_sample_columns(c.spec, F.col("record_id"), F.col("failed_value")),
                F.col("copies").cast("bigint").alias("copies")))
    if not parts:
        return plan.ctx.tables.spark.createDataFrame([], schemas.FAILED_RECORDS)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    shared = Window.partitionBy("label", "share").orderBy("record_identifier", "failed_value")
    found = found.withColumn("share", F.pmod(F.xxhash64("record_identifier", "failed_value"), F.lit(SAMPLE_SHARES)))
    found = found.withColumn("place", F.row_number().over(shared)).where(F.col("place") <= limit).drop("place", "share")
    order = Window.partitionBy("label").orderBy("record_identifier", "failed_value")
    first = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    repeated = first.select("*", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(limit)))).alias("copy"))
    kept = repeated.withColumn(
        "place", F.row_number().over(order.orderBy("record_identifier", "failed_value", "place", "copy"))
    ).where(F.col("place") <= limit)
    return kept.select(
        F.sha2(F.concat_ws("|", F.lit(plan.run_id), "label", "place"), 256).substr(1, 36).alias("failure_id"),
        F.lit(plan.run_id).alias("run_id"),
        "check_id",
        F.lit(plan.ctx.table).alias("target_table"),
        "record_identifier", "column_name", "failed_value", "failure_reason",
        as_of_column(plan.ctx.as_of).alias("created_at"),
    )


def run_summary(results: DataFrame, started: Column, ended: Column, catalog: str = "main",
                namespace: str = "public", trigger: str = "MANUAL") -> DataFrame:
    """One run row per run id, from results of tables of one database and schema; warnings count as failed, errors only change the overall status."""
    status = F.col("check_status")
    return results.groupBy("run_id", "target_table").agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(status == "PASS").alias("passed_checks"),
        F.count_if(status.isin("FAIL", "WARNING")).alias("failed_checks"),
        F.when(F.count_if(status == "ERROR") > 0, "COMPLETED_WITH_ERRORS")
        .otherwise("COMPLETED").alias("overall_status"),
    ).select(
        "run_id", started.alias("run_start_time"), ended.alias("run_end_time"),
        F.lit(catalog).alias("target_database"), F.lit(namespace).alias("target_schema"), "target_table",
        "total_checks", "passed_checks", "failed_checks", "overall_status",
        F.lit(trigger).alias("triggered_by"), started.alias("created_at"),
    )


@dataclass
class TableRun:
    plan: TablePlan
    rows: list
    elapsed_ms: int


def execute_table(plan: TablePlan) -> TableRun:
    """Run a table's checks now. If the shared job fails, each check runs alone and only the
    failing ones become ERROR rows. One row per check comes back to the driver."""
    started = time.monotonic()
    if not plan.bound and not plan.errors:
        return TableRun(plan, [], 0)
    try:
        rows = _labelled_results(plan).collect()
    except Exception:
        rows = []
        for check in plan.bound:
            alone = TablePlan(plan.ctx, plan.run_id, [check])
            try:
                rows += _labelled_results(alone).collect()
            except Exception as error:
                plan.errors.append((check.spec, str(error)[:ERROR_LENGTH]))
        failed = {spec.label for spec, _ in plan.errors}
        plan.bound = [c for c in plan.bound if c.spec.label not in failed]
        if plan.errors:
            rows += _labelled_results(TablePlan(plan.ctx, plan.run_id, [], plan.errors)).collect()
    elapsed = int((time.monotonic() - started) * 1000)
    rows.sort(key=lambda r: (r.check_id, r.target_column or ""))
    return TableRun(plan, [{**r.asDict(), "execution_time_ms": elapsed} for r in rows], elapsed)


@dataclass
class FullRun:
    results: DataFrame
    failed_records: DataFrame
    run_log: DataFrame
    summary: DataFrame


def run_all(
    spark: SparkSession, contexts: Iterable[TableContext], specs: Iterable[CheckSpec], parallel: int = 4
) -> FullRun:
    """All tables, several at a time; a table that cannot be read is reported, the others continue.

    Each table's samples are written as soon as its checks are done, so that no plan grows with the number of tables.
    """
    specs = list(specs)
    contexts = sorted(contexts, key=lambda c: (c.catalog, c.namespace, c.table))
    folder = scratch_path(spark, "samples")

    def one(ctx: TableContext):
        try:
            run = execute_table(plan_table(ctx, specs_of(ctx, specs)))
            failing = {r["label"] for r in run.rows if r["check_status"] in ("FAIL", "WARNING")}
            if failing:
                failed_records(without_passed(run.plan, failing)).write.parquet(f"{folder}/{run.plan.run_id}")
            return ctx, run, None
        except Exception as error:
            return ctx, None, f"ERROR: {str(error)[:200]}"

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        outcomes = list(pool.map(one, contexts))
    done = [(ctx, run) for ctx, run, _ in outcomes if run is not None]
    rows = [tuple(r[c] for c in schemas.CHECK_RESULTS.fieldNames()) for _, run in done for r in run.rows]
    results = spark.createDataFrame(rows, schemas.CHECK_RESULTS)
    if any(r["check_status"] in ("FAIL", "WARNING") for _, run in done for r in run.rows):
        samples = spark.read.schema(schemas.FAILED_RECORDS).option("recursiveFileLookup", "true").parquet(folder)
    else:
        samples = spark.createDataFrame([], schemas.FAILED_RECORDS)
    log_rows = []
    for ctx, run in done:
        if not run.rows:
            continue
        status = [r["check_status"] for r in run.rows]
        ended = ctx.as_of + dt.timedelta(milliseconds=run.elapsed_ms)
        log_rows.append((
            run.plan.run_id, ctx.as_of, ended, ctx.catalog, ctx.namespace, ctx.table, len(status),
            status.count("PASS"), status.count("FAIL") + status.count("WARNING"),
            "COMPLETED_WITH_ERRORS" if "ERROR" in status else "COMPLETED", "MANUAL", ctx.as_of))
    run_log = spark.createDataFrame(log_rows, schemas.RUN_LOG)
    states = [
        (ctx.catalog, ctx.namespace, ctx.table, run.plan.run_id if run else None, "COMPLETED" if run else error)
        for ctx, run, error in outcomes
    ]
    summary = spark.createDataFrame(
        states, "target_database string, target_schema string, target_table string, run_id string, status string")
    return FullRun(results, samples, run_log, summary)


def run_all_document(summary: DataFrame) -> DataFrame:
    """The outcome of a full run as one JSON document."""
    succeeded = F.count_if(F.col("status") == "COMPLETED")
    return summary.agg(
        F.to_json(F.struct(
            F.when(succeeded < F.count(F.lit(1)), "COMPLETED_WITH_ERRORS").otherwise("COMPLETED")
            .alias("overall_status"),
            F.count(F.lit(1)).alias("tables_processed"),
            succeeded.alias("tables_succeeded"),
            (F.count(F.lit(1)) - succeeded).alias("tables_failed"),
            F.array_sort(F.collect_list(F.struct("target_table", "run_id", "status"))).alias("runs"),
        )).alias("document")
    )
