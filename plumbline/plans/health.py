"""Health scores and the views over runs and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scoring import health_band
from plumbline.operators.skew import group_apart


def health_scores(results: DataFrame, scored_at: Column | None = None) -> DataFrame:
    """Weighted score per run and table: full weight for PASS, half for WARNING, none for FAIL.

    Errored checks do not take part, so a run with nothing but errors has no score. One grouped
    pass covers all runs.
    """
    status, weight = F.col("check_status"), F.col("weight")
    earned = F.when(status == "PASS", weight).when(status == "WARNING", weight * F.lit("0.5").cast("decimal(2,1)"))
    total = F.sum(weight)
    score = F.when(total == 0, F.lit(100).cast("decimal(5,2)")).otherwise(
        F.round(F.sum(F.coalesce(earned, F.lit(0).cast("decimal(2,1)"))) * 100 / F.nullif(total, F.lit(0)), 2)
        .cast("decimal(5,2)")
    )

    def broken(severity: str) -> Column:
        return F.count_if((F.col("severity") == severity) & (status != "PASS"))

    scored = results.where(status != "ERROR").groupBy("run_id", "target_table").agg(
        score.alias("health_score"),
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(status == "PASS").alias("passed_checks"),
        F.count_if(status.isin("FAIL", "WARNING")).alias("failed_checks"),
        broken("CRITICAL").alias("critical_failures"),
        broken("HIGH").alias("high_failures"),
        broken("MEDIUM").alias("medium_failures"),
        broken("LOW").alias("low_failures"),
    )
    if scored_at is None:
        return scored
    return scored.select(
        F.sha2(F.concat_ws("|", "run_id", "target_table"), 256).substr(1, 36).alias("score_id"),
        *scored.columns, scored_at.alias("score_calculated_at"),
    )


def check_summary(results: DataFrame, run_log: DataFrame) -> DataFrame:
    """One row per check result, with its run's table and start."""
    runs = run_log.select("run_id", "target_table", "run_start_time")
    return results.drop("target_table").join(runs, "run_id").select(
        "run_id", "target_table", "check_id", "check_name", "target_column", "check_status", "severity",
        "total_rows", "failure_count", "failure_pct", "weight", "execution_time_ms", "error_message",
        "run_start_time",
    )


def _with_failed_records(scores: DataFrame, run_log: DataFrame, failed_records: DataFrame) -> DataFrame:
    counts = failed_records.groupBy("run_id").agg(F.count(F.lit(1)).alias("failed_record_count"))
    runs = run_log.select("run_id", "overall_status", "run_start_time")
    return scores.join(runs, "run_id").join(counts, "run_id", "left")


def _neither() -> Column:
    return (F.col("total_checks") - F.col("passed_checks") - F.col("failed_checks")).alias("warning_checks")


def table_health(scores: DataFrame, run_log: DataFrame, failed_records: DataFrame) -> DataFrame:
    """One row per scored run. Warnings already count as failed, so ``warning_checks`` stays 0."""
    return _with_failed_records(scores, run_log, failed_records).select(
        "target_table", "run_id", "health_score", "total_checks", "passed_checks", "failed_checks", _neither(),
        "critical_failures", "high_failures", "medium_failures", "low_failures",
        F.coalesce("failed_record_count", F.lit(0)).alias("failed_record_count"),
        "overall_status", "run_start_time",
    )


def overall_health(scores: DataFrame, run_log: DataFrame, failed_records: DataFrame) -> DataFrame:
    """One row over all scored runs; the status band uses the unrounded mean."""
    mean = F.avg("health_score")
    return _with_failed_records(scores, run_log, failed_records).agg(
        F.round(mean, 2).alias("overall_health_score"),
        F.count_distinct("target_table").alias("tables_evaluated"),
        F.sum("total_checks").alias("total_checks"),
        F.sum("passed_checks").alias("passed_checks"),
        F.sum("failed_checks").alias("failed_checks"),
        F.coalesce(F.sum("failed_record_count"), F.lit(0)).alias("total_failed_records"),
        health_band(mean).alias("overall_status"),
        F.max("run_start_time").alias("latest_run"),
    ).select(
        "overall_health_score", "tables_evaluated", "total_checks", "passed_checks", "failed_checks", _neither(),
        "total_failed_records", "overall_status", "latest_run",
    )


def score_document(scores: DataFrame) -> DataFrame:
    """Each score as a JSON document."""
    return scores.select("run_id", F.to_json(F.struct(
        "run_id", "target_table", "health_score", "total_checks",
        F.col("passed_checks").alias("passed"), F.col("failed_checks").alias("failed"),
        F.col("critical_failures").alias("critical"), F.col("high_failures").alias("high"),
        F.col("medium_failures").alias("medium"), F.col("low_failures").alias("low"),
    )).alias("document"))


def score_changes(scores: DataFrame, run_log: DataFrame, cutoff: Column) -> DataFrame:
    """Every scored run up to ``cutoff`` against the newest later run of the same table.

    A later run without a score counts as no change.
    """
    runs = run_log.join(scores.select("run_id", "health_score"), "run_id", "left")
    before = runs.where((F.col("run_start_time") <= cutoff) & F.col("health_score").isNotNull())
    after = group_apart(
        runs.where(F.col("run_start_time") > cutoff), ["target_table"],
        F.max(F.struct("run_start_time", "run_id", "health_score", "failed_checks")).alias("rerun"),
    )
    change = F.coalesce(
        F.col("rerun.health_score").cast("decimal(6,2)") - F.col("health_score"), F.lit(0).cast("decimal(6,2)")
    )
    return before.join(after, "target_table").select(
        F.col("run_id").alias("original_run_id"),
        F.col("rerun.run_id").alias("rerun_run_id"),
        "target_table",
        F.col("health_score").alias("original_health_score"),
        F.col("rerun.health_score").alias("rerun_health_score"),
        change.alias("score_change"),
        F.col("failed_checks").alias("original_failed_checks"),
        F.col("rerun.failed_checks").alias("rerun_failed_checks"),
        F.when(change > 0.01, "IMPROVED").when(change < -0.01, "DEGRADED").otherwise("UNCHANGED")
        .alias("improvement_status"),
    )
