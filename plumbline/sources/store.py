"""Result tables on shared storage: append by run, replace by run, follow what changed."""

from __future__ import annotations

import datetime as dt
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schemas
from plumbline.operators.delta import INSERT, change_rows
from plumbline.session import cut_lineage, setting

PLACE = ("database_name", "schema_name", "table_name")
RUN_CHECK = ("run_id", "check_id", "target_table")
# Schema, the moment by which rows are laid out, what makes up one unit that is written and replaced whole, and by
# which columns a row is known from one version of its unit to the next.
TABLES = {
    "run_log": (schemas.RUN_LOG, "run_start_time", ("run_id",), ("run_id",)),
    "check_results": (schemas.CHECK_RESULTS, "created_at", ("run_id",), (*RUN_CHECK, "target_column")),
    "failed_records": (
        schemas.FAILED_RECORDS, "created_at", ("run_id",), (*RUN_CHECK, "column_name", "record_identifier")),
    "health_scores": (schemas.HEALTH_SCORES, "score_calculated_at", ("run_id",), ("run_id", "target_table")),
    "table_profiles": (schemas.TABLE_PROFILES, "profiled_at", (*PLACE, "profiled_at"), (*PLACE, "profiled_at")),
    "column_profiles": (
        schemas.COLUMN_PROFILES, "profiled_at", (*PLACE, "profiled_at"), (*PLACE, "profiled_at", "column_name")),
    "profile_states": (
        schemas.PROFILE_STATES, "profiled_at", (*PLACE, "part"), (*PLACE, "part", "column_name")),
    "distribution_snapshots": (
        schemas.DISTRIBUTION_SNAPSHOTS, "snapshot_at", (*PLACE, "snapshot_at"),
        (*PLACE, "snapshot_at", "column_name", "value_or_bucket")),
    "schema_snapshots": (
        schemas.SCHEMA_SNAPSHOTS, "snapshot_at", ("table_catalog", "table_schema", "table_name", "snapshot_at"),
        ("table_catalog", "table_schema", "table_name", "snapshot_at", "column_name")),
    "analysis_cache": (schemas.ANALYSIS_CACHE, "created_at", ("analysis_id",), ("analysis_id",)),
    "recommendations": (schemas.RECOMMENDATIONS, "created_at", ("recommendation_id",), ("recommendation_id",)),
    "approval_queue": (schemas.APPROVAL_QUEUE, "requested_at", ("approval_id",), ("approval_id",)),
    "remediation_audit": (schemas.REMEDIATION_AUDIT, "executed_at", ("audit_id",), ("audit_id",)),
}
COMMITS = T.StructType().add("unit", "string").add("version", "long").add("write_id", "string").add(
    "replaces", "boolean").add("run_day", "date")
PUBLISHED = T.StructType().add("write_id", "string")
DAYS_AT_ONCE = 32


def _by_day(df: DataFrame, path: str, mode: str = "append", **options: str) -> None:
    """Write rows into the folders of their days.

    A task keeps the files of its days open side by side, so its rows are not sorted first; only what comes for still
    further days is. Stored rows are alike and shrink in a shuffle, so a small part of it may hold very many of them.
    """
    with setting(df.sparkSession, "spark.sql.maxConcurrentOutputFileWriters", DAYS_AT_ONCE):
        df.hint("rebalance", "run_day").write.mode(mode).options(**options).partitionBy("run_day").parquet(path)


class ResultStore:
    """Parquet result tables, laid out by day; folders grow with the days, not with the runs.

    Nothing stored is ever rewritten. A write adds its rows under an id of its own and then one line for each unit it
    concerns to the commits, by which it becomes visible. Readers take of each unit the rows of its last replacement and what was
    appended since. So two writers never undo each other, and a write that fails halfway is never seen; of two
    replacements of one unit the later commit stands. ``vacuum`` takes out what nobody sees any more.

    After its commit a write adds to the change log what it changed: rows with ``change_type``, of both states for an
    update. Streams read that log, whose files are never replaced, so each change arrives once. ``recover`` adds the
    changes of writes that failed after their commit; run it in one process at a time.

    Readers that ask for the time since a moment list and scan only the days from there on.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str, part: str = "rows") -> str:
        return f"{self.root}/{table}/{part}"

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to their units."""
        self._write(table, df, None, False)

    def replace(self, table: str, df: DataFrame, units: DataFrame | None = None) -> None:
        """Write ``df`` in place of what its units held; others stay.

        ``units`` names units that are replaced even if no row of ``df`` belongs to them; it has the columns of
        the unit and the moment.
        """
        self._write(table, df, units, True)

    def replace_runs(self, table: str, df: DataFrame, runs: DataFrame | None = None) -> None:
        self.replace(table, df, runs)

    def clear(self, table: str) -> None:
        """Take all rows out. They are gone for readers, and deleted for followers; ``vacuum`` frees their room."""
        held = self._all(table)
        self.replace(table, held.limit(0).select(*TABLES[table][0].fieldNames()), held)

    def _unit(self, table: str) -> Column:
        return F.to_json(F.struct(*TABLES[table][2]), {"ignoreNullFields": "false"})

    def _write(self, table: str, df: DataFrame, units: DataFrame | None, replaces: bool) -> None:
        _, moment, unit, _ = TABLES[table]
        write_id, version = uuid.uuid4().hex, time.time_ns()
        day = F.to_date(moment).alias("run_day")
        placed = df.withColumns({"unit": self._unit(table), "write_id": F.lit(write_id), "run_day": F.to_date(moment)})
        _by_day(placed, self.path(table))
        stored = self._rows(table).where(F.col("write_id") == write_id)
        named = stored.select("unit", "run_day")
        if units is not None:
            named = named.unionByName(units.select(self._unit(table).alias("unit"), day))
        named = cut_lineage(named.distinct(), "units")
        if replaces:
            # A unit that lay on other days is marked there as well, for readers that see only these.
            before = self._commits(table).select("unit", "run_day").distinct()
            named = cut_lineage(named.unionByName(
                before.join(named.select("unit").distinct(), "unit", "left_semi")).distinct(), "units")
        named.select("unit", F.lit(version).alias("version"), F.lit(write_id).alias("write_id"),
                     F.lit(replaces).alias("replaces"), "run_day").coalesce(1).write.mode("append").partitionBy(
            "run_day").parquet(self.path(table, "commits"))
        self._publish(table, write_id, version)

    def _publish(self, table: str, write_id: str, version: int) -> None:
        """Add to the change log what one committed write changed in its units."""
        names, keys = TABLES[table][0].fieldNames(), list(TABLES[table][3])
        commits = self._commits(table)
        own = commits.where(F.col("write_id") == write_id)
        touched = commits.join(own.select("unit").distinct(), "unit", "left_semi")
        here = F.struct(F.lit(version).alias("version"), F.lit(write_id).alias("write_id"))
        after = self._rows(table).where(F.col("write_id") == write_id)
        earlier = touched.where(_order() < here)
        # As many days as the touched units lie on, so that only their folders are listed.
        days = []
        if not own.where("replaces").isEmpty():
            days = [r.run_day for r in earlier.select("run_day").distinct().collect()]
        if not days:
            changes = after.select(*names).withColumns({"change_type": F.lit(INSERT), "change_count": F.lit(1).cast("long")})
        else:
            rows = self._rows(table).where(F.col("run_day").isin([d for d in days if d is not None]) | (
                F.col("run_day").isNull() if None in days else F.lit(False)))
            old = rows.join(_visible(earlier), ["unit", "write_id"], "left_semi")
            changes = change_rows(old.select(*names), after.select(*names), keys)
        _by_day(changes.withColumns({
            "version": F.lit(version), "write_id": F.lit(write_id), "run_day": F.to_date(TABLES[table][1])}),
            self.path(table, "changes"))
        self.spark.createDataFrame([(write_id,)], PUBLISHED).coalesce(1).write.mode("append").parquet(
            self.path(table, "published"))

    def recover(self, table: str) -> int:
        """Publish the writes that were committed but whose changes were not added; returns how many."""
        # A write without any change is known by its mark alone, one that failed before its mark by its changes.
        known = self.changes(table).select("write_id").unionByName(self._parquet(table, "published", PUBLISHED)).distinct()
        lost = self._commits(table).select("version", "write_id").distinct().join(known, "write_id", "left_anti")
        rows = lost.orderBy("version").collect()
        for row in rows:
            self._publish(table, row.write_id, row.version)
        return len(rows)

    def vacuum(self, table: str, days: list[dt.date]) -> None:
        """Rewrite the given days without superseded rows; nobody else may write to them meanwhile."""
        rows = self._rows(table).where(F.col("run_day").isin(days))
        seen = rows.join(_visible(self._commits(table)), ["unit", "write_id"], "left_semi")
        kept = cut_lineage(seen.select(*self._stored_schema(table).fieldNames()), "kept")
        hollow = self.spark.createDataFrame([(d,) for d in days], "run_day date").join(
            kept.select("run_day").distinct(), "run_day", "left_anti")
        # A day without rows is overwritten by a row that belongs to no unit.
        _by_day(kept.unionByName(hollow, allowMissingColumns=True), self.path(table), "overwrite", partitionOverwriteMode="dynamic")

    def _stored_schema(self, table: str) -> T.StructType:
        return T.StructType([
            *TABLES[table][0].fields, T.StructField("unit", T.StringType()), T.StructField("write_id", T.StringType()),
            T.StructField("run_day", T.DateType())])

    def change_schema(self, table: str) -> T.StructType:
        return T.StructType(TABLES[table][0].fields[:]).add("change_type", "string").add("change_count", "long").add(
            "version", "long").add("write_id", "string").add("run_day", "date")

    def _parquet(self, table: str, part: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self.path(table, part))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _rows(self, table: str) -> DataFrame:
        return self._parquet(table, "rows", self._stored_schema(table))

    def _commits(self, table: str) -> DataFrame:
        return self._parquet(table, "commits", COMMITS)

    def _all(self, table: str, since: dt.datetime | None = None) -> DataFrame:
        rows, commits = self._rows(table), self._commits(table)
        if since:
            rows, commits = (df.where(F.col("run_day") >= F.lit(since.date())) for df in (rows, commits))
        return rows.join(_visible(commits), ["unit", "write_id"], "left_semi")

    def read(self, table: str, since: dt.datetime | None = None) -> DataFrame:
        """The stored rows, of the days from ``since`` on; none before the first write.

        Columns added by later versions are NULL in older files.
        """
        return self._all(table, since).select(*TABLES[table][0].fieldNames(), "run_day")

    def changes(self, table: str) -> DataFrame:
        """The change log: rows with change_type, change_count (of equal rows) and the version that changed them."""
        return self._parquet(table, "changes", self.change_schema(table))

    def stream(self, table: str, files_per_trigger: int | None = None) -> DataFrame:
        """The change log as a stream."""
        reader = self.spark.readStream.schema(self.change_schema(table))
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        return reader.parquet(self.path(table, "changes"))


def _order() -> Column:
    return F.struct("version", "write_id")


def _visible(commits: DataFrame) -> DataFrame:
    """(unit, write_id) of the writes whose rows count: the last replacement of a unit and all appended since."""
    log = commits.select("unit", _order().alias("at"), "replaces").distinct()
    last = log.groupBy("unit").agg(F.max(F.when(F.col("replaces"), F.col("at"))).alias("last"))
    return log.join(last, "unit").where("last IS NULL OR at >= last").select("unit", F.col("at.write_id").alias("write_id"))
