"""Recommendations, approvals and executions: views and apply decisions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.predicates import as_of_column
from plumbline.functions.text import REVIEW, SAFE
from plumbline.operators.skew import keep_left

RECOMMENDATION = "REMEDIATION_RECOMMENDATION"
EXPLANATION = "FAILURE_EXPLANATION"
PROFILE = "PROFILE"


def _joined(cache: DataFrame, approvals: DataFrame, audit: DataFrame) -> DataFrame:
    """Recommendations with their approvals and executions; several of either give several rows."""
    replies = cache.where(F.col("analysis_type") == RECOMMENDATION).select(
        "analysis_id", "run_id", "check_id", "target_table", "analysis_type", "ai_response",
        F.col("status").alias("recommendation_status"), "created_at",
    )
    asked = approvals.select(
        F.col("recommendation_id").alias("analysis_id"), F.col("approval_status").alias("queue_status"),
        "requested_at", "reviewer", "review_comments",
    )
    done = audit.select(
        "analysis_id", F.col("status").alias("audit_status"), "action_sql", "error_message", "executed_at",
        "executed_by",
    )
    return keep_left(keep_left(replies, asked, ["analysis_id"]), done, ["analysis_id"])


def pending_remediations(cache: DataFrame, approvals: DataFrame, audit: DataFrame) -> DataFrame:
    safety = text.classify_safety_like(F.col("ai_response"))
    queue, executed = F.col("queue_status"), F.col("audit_status")
    action = (
        F.when(executed == "SUCCESS", "APPLIED")
        .when(executed == "FAILED", "EXECUTION_FAILED")
        .when(queue == "REJECTED", "REJECTED")
        .when(queue == "APPROVED", "APPROVED_PENDING_EXECUTION")
        .when(safety == SAFE, "SAFE_READY")
        .when(safety == REVIEW, "AWAITING_HUMAN_REVIEW")
        .otherwise("PENDING")
    )
    waiting = F.when(safety == SAFE, "AUTO_ELIGIBLE").otherwise("AWAITING_REVIEW")
    return _joined(cache, approvals, audit).select(
        F.col("analysis_id").alias("recommendation_id"), "analysis_id", "run_id", "check_id", "target_table",
        F.col("analysis_type").alias("recommendation_type"),
        F.col("ai_response").alias("recommendation_text"),
        safety.alias("safety_classification"), "recommendation_status",
        F.coalesce(queue, waiting).alias("approval_status"), "requested_at", "created_at",
        F.col("executed_at").alias("last_executed_at"), action.alias("action_status"),
    )


def remediation_history(cache: DataFrame, approvals: DataFrame, audit: DataFrame) -> DataFrame:
    return _joined(cache, approvals, audit).select(
        F.col("analysis_id").alias("recommendation_id"), "analysis_id", "run_id", "check_id", "target_table",
        text.classify_safety_like(F.col("ai_response")).alias("safety_classification"),
        "recommendation_status",
        F.coalesce("queue_status", F.lit("N/A")).alias("approval_status"),
        F.coalesce("audit_status", F.lit("NOT_EXECUTED")).alias("execution_status"),
        "action_sql", "error_message", "reviewer", "review_comments", "executed_at", "executed_by", "created_at",
    )


def apply_decisions(cache: DataFrame, audit: DataFrame, whole_words: bool = True) -> DataFrame:
    """What would become of every cached reply if its fix were applied now.

    READY replies carry the statement; everything else names the guard that stopped it.
    """
    reply = F.col("ai_response")
    applied = (
        audit.where(F.col("status") == "SUCCESS").select("analysis_id").distinct()
        .withColumn("applied", F.lit(True))
    )
    read = cache.join(applied, "analysis_id", "left").select(
        "analysis_id", "target_table", "analysis_type", "applied",
        text.classify_safety(reply, whole_words).alias("safety_classification"),
        text.extract_statement(reply).alias("statement"),
    ).withColumn("guard", text.guard_statement(F.col("statement")))
    status = (
        F.when(F.col("analysis_type") != RECOMMENDATION, "ERROR")
        .when(F.col("safety_classification") != SAFE, "SKIPPED")
        .when(F.col("guard.status") != "ACCEPTED", F.col("guard.status"))
        .when(F.col("applied"), "ALREADY_APPLIED")
        .otherwise("READY")
    )
    message = (
        F.when(F.col("analysis_type") != RECOMMENDATION,
               F.concat(F.lit("not a recommendation: "), "analysis_type"))
        .when(F.col("safety_classification") != SAFE,
              F.concat(F.lit("needs review: "), "safety_classification"))
        .when(F.col("guard.status") != "ACCEPTED", F.col("guard.message"))
        .when(F.col("applied"), "already applied")
    )
    return read.select(
        F.col("analysis_id").alias("recommendation_id"), "target_table", "safety_classification",
        status.alias("status"), message.alias("message"),
        F.when(status == "READY", F.col("statement")).alias("action_sql"),
    )


def audit_rows(
    decisions: DataFrame, outcomes: DataFrame, executed_at: dt.datetime, executed_by: str
) -> DataFrame:
    """Audit rows for executed decisions; ``outcomes`` gives ``recommendation_id`` and an error, if any."""
    return decisions.where("status = 'READY'").join(outcomes, "recommendation_id").select(
        F.sha2(F.concat_ws("|", "recommendation_id", F.lit(executed_at.isoformat())), 256).substr(1, 36)
        .alias("audit_id"),
        F.col("recommendation_id").alias("analysis_id"), "target_table", "action_sql",
        F.when(F.col("error_message").isNull(), "SUCCESS").otherwise("FAILED").alias("status"),
        "error_message", F.lit(executed_by).alias("executed_by"),
        as_of_column(executed_at).alias("executed_at"),
    )


def badge(safety: Column) -> Column:
    return F.when(safety == SAFE, "SAFE").when(safety == REVIEW, "HUMAN REVIEW").otherwise(safety)


def latest_analysis(cache: DataFrame, keys: list[str]) -> DataFrame:
    """The newest analysis of every key; equal times are settled by the id."""
    return cache.groupBy("analysis_type", *keys).agg(
        F.max(F.struct("created_at", "analysis_id")).alias("newest")
    ).select("analysis_type", *keys, F.col("newest.analysis_id").alias("analysis_id"),
             F.col("newest.created_at").alias("created_at"))


def replace_analyses(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """Store analyses, each in place of an earlier one for the same type, run, check and column."""
    keys = ["analysis_type", "run_id", "check_id", "target_column"]
    affected = rows.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        part = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = part if same is None else same & part
    return cache.join(affected, same, "left_anti").unionByName(rows)
