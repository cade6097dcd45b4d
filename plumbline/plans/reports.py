"""Report texts assembled from result tables, one per table, check result or reply key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES_IN_REPORT = 5
DISTRIBUTION_LINES = 50

TABLE_KEYS = ["database_name", "schema_name", "table_name"]
SAMPLE_KEYS = ["run_id", "check_id", "column_name"]


def _text(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("string")


def _line(label: str, value) -> Column:
    """``label`` and value; an absent value is spelled out so that no line is lost."""
    return F.concat(F.lit(label), F.coalesce(_text(value), F.lit("null")))


def _joined_lines(entries: Column) -> Column:
    """Lines of ``struct(order..., line)`` entries, in order."""
    return F.array_join(F.transform(F.array_sort(entries), lambda e: e["line"]), "\n")


def profile_reports(table_profiles: DataFrame, column_profiles: DataFrame, distributions: DataFrame,
                    lines: int = DISTRIBUTION_LINES) -> DataFrame:
    """The newest profile of each table as text.

    Columns are listed by name with their newest statistics, absent ones left out, so that the text
    does not grow with the profile history. The first ``lines`` distribution rows of the newest snapshot of each
    column, by column and count, follow under a header per column.
    """
    newest = Window.partitionBy(*TABLE_KEYS).orderBy(F.desc("profiled_at"), "profile_id")
    latest = (
        table_profiles.withColumn("place", F.row_number().over(newest)).where("place = 1")
        .select(*TABLE_KEYS, F.col("row_count").alias("rows"), "column_count", "profiled_at")
    )
    details = F.concat_ws(
        ", ",
        F.concat(F.lit("nulls="), _text("null_count"), F.lit(" ("), _text("null_pct"), F.lit("%)")),
        F.concat(F.lit("distinct="), _text("distinct_count")),
        F.concat(F.lit("min="), F.col("min_value")),
        F.concat(F.lit("max="), F.col("max_value")),
        F.concat(F.lit("mean="), _text("mean")),
        F.concat(F.lit("median="), _text("median")),
    )
    head = F.concat(F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("data_type"), F.lit(")"))
    line = F.when(details != "", F.concat(head, F.lit(": "), details)).otherwise(head)
    per_column = Window.partitionBy(*TABLE_KEYS, "column_name").orderBy(F.desc("profiled_at"))
    current = column_profiles.withColumn("place", F.row_number().over(per_column)).where("place = 1")
    columns = current.groupBy(*TABLE_KEYS).agg(
        _joined_lines(F.collect_list(F.struct("column_name", line.alias("line")))).alias("columns_text")
    )

    order = Window.partitionBy(*TABLE_KEYS).orderBy("column_name", F.desc("record_count"), "value_or_bucket")
    of_column = Window.partitionBy(*TABLE_KEYS, "column_name")
    in_column = of_column.orderBy("place")
    shown = (
        distributions.withColumn("newest", F.max("snapshot_at").over(of_column)).where("snapshot_at = newest")
        .dropDuplicates([*TABLE_KEYS, "column_name", "value_or_bucket"])
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= lines)
        .withColumn("first", F.row_number().over(in_column) == 1)
    )
    entry = F.concat(
        F.lit("  "), F.col("value_or_bucket"), F.lit(": "), _text("record_count"), F.lit(" rows ("),
        _text("percentage"), F.lit("%)"),
    )
    with_header = F.when(
        F.col("first"), F.concat(F.lit("Column "), F.col("column_name"), F.lit(":\n"), entry)
    ).otherwise(entry)
    values = shown.groupBy(*TABLE_KEYS).agg(
        _joined_lines(F.collect_list(F.struct("place", with_header.alias("line")))).alias("values_text")
    )
    name = F.concat_ws(".", *TABLE_KEYS)
    return latest.join(columns, TABLE_KEYS, "left").join(values, TABLE_KEYS, "left").select(
        name.alias("table_fqn"),
        F.concat(
            F.concat_ws("\n", _line("Profile of ", name), _line("taken ", "profiled_at"),
                        F.concat(_line("", "rows"), F.lit(" rows in "), _line("", "column_count"), F.lit(" columns"))),
            F.lit("\n\nColumns\n"), F.coalesce("columns_text", F.lit("")), F.lit("\n"),
            F.coalesce(F.concat(F.lit("\nValues\n"), F.col("values_text"), F.lit("\n")), F.lit("")),
        ).alias("report"),
    )


def _sample_line() -> Column:
    parts = [("* ", "record_identifier"), (": ", "column_name"), (" = ", "failed_value"), (", ", "failure_reason")]
    return F.concat(*[_line(label, column) for label, column in parts])


def _samples(failed_records: DataFrame, first_of_run: int | None) -> DataFrame:
    """The first failing records of each run, check and column as text."""
    rows = failed_records
    if first_of_run:
        run_order = Window.partitionBy("run_id").orderBy(
            "check_id", "created_at", "record_identifier", "failed_value", "column_name")
        rows = rows.withColumn("in_run", F.row_number().over(run_order)).where(F.col("in_run") <= first_of_run)
    order = Window.partitionBy(*SAMPLE_KEYS).orderBy("created_at", "record_identifier", "failed_value", "failure_reason")
    kept = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLES_IN_REPORT)
    return kept.groupBy(*SAMPLE_KEYS).agg(
        _joined_lines(F.collect_list(F.struct("place", _sample_line().alias("line")))).alias("samples_text")
    )


def _outcome_text() -> Column:
    """What was checked and what came out, behind the name of the table. Limits are numbers of failing rows."""
    return F.concat_ws(
        "\n",
        _line(": ", "check_name"),
        F.concat(_line("Category ", "category"), _line(", severity ", "severity")),
        _line("Purpose: ", "description"),
        F.concat(_line("Outcome: ", "check_status"), _line(" with ", "failure_count"), _line(" of ", "total_rows"),
                 F.lit(" rows failing"), _line(", a share of ", "failure_pct")),
        F.concat(_line("Limits: warn from ", "threshold_warning"), _line(" on, fail from ", "threshold_fail"),
                 F.lit(" on")),
    )


def _check_text() -> Column:
    return F.concat(_line("Check ", "check_id"), _line(" on ", _table_name()), F.col("outcome_text"), F.lit("\n"))


def _samples_section() -> Column:
    return F.coalesce(F.concat(F.lit("\nExamples\n"), F.col("samples_text"), F.lit("\n")), F.lit(""))


def _table_name() -> Column:
    return F.concat_ws(".", F.coalesce("target_database", F.lit("")), F.coalesce("target_schema", F.lit("")), "target_table")


def _located_results(results: DataFrame, library: DataFrame, run_log: DataFrame) -> DataFrame:
    """Results with the names of their runs. What only shows in the text is text before any row is shuffled."""
    catalog = library.select("check_id", "category", "description")
    runs = run_log.select("run_id", "target_database", "target_schema")
    told = results.join(catalog, "check_id").withColumn("outcome_text", _outcome_text())
    shown = [c for c in ("result_id", "run_id", "check_id", "target_table", "target_column", "outcome_text") if c in told.columns]
    return told.select(*shown).join(runs, "run_id", "left")


def _with_samples(located: DataFrame, samples: DataFrame) -> DataFrame:
    """Keys are compared as expressions, so that no copy of the column travels; samples of a check without one say N/A."""
    named = samples.toDF(*[f"__{c}" if c in SAMPLE_KEYS else c for c in samples.columns])
    return located.join(named, (F.col("run_id") == F.col("__run_id")) & (F.col("check_id") == F.col("__check_id")) & (
        F.coalesce("target_column", F.lit("N/A")) == F.col("__column_name")), "left")


def failure_reports(
    results: DataFrame, library: DataFrame, run_log: DataFrame, failed_records: DataFrame,
    first_of_run: int | None = None,
) -> DataFrame:
    """One text per failed or warned check, with a few of its first failing records.

    ``first_of_run`` bounds the records of a whole run, by check, before examples are chosen.
    """
    failing = results.where(F.col("check_status").isin("FAIL", "WARNING"))
    located = _located_results(failing, library, run_log)
    samples = _samples(failed_records, first_of_run)
    body = F.concat(_check_text(), _samples_section())
    return _with_samples(located, samples).select(
        "run_id", "check_id", "target_column", _table_name().alias("table_fqn"), body.alias("report")
    )


def remediation_reports(
    results: DataFrame, library: DataFrame, run_log: DataFrame, failed_records: DataFrame, assignments: DataFrame
) -> DataFrame:
    """One text per result that did not pass, with the parameters of its assignment.

    The parameters are those of the same check, table and column, the first by id when several
    assignments match.
    """
    located = _located_results(results.where("check_status <> 'PASS'"), library, run_log)
    samples = _samples(failed_records, None)
    params = (
        assignments.where("is_active")
        .groupBy(F.col("check_id").alias("__check"), F.col("target_table").alias("__table"),
                 F.coalesce("target_column", F.lit("")).alias("__column"))
        .agg(F.min_by(F.to_json("params"), "assignment_id").alias("params_text"))
    )
    assigned = (F.col("check_id") == F.col("__check")) & (F.col("target_table") == F.col("__table")) & (
        F.coalesce("target_column", F.lit("")) == F.col("__column"))
    column_line = F.concat(F.lit("Column: "), F.col("target_column"), F.lit("\n"))
    params_line = F.concat(F.lit("Parameters: "), F.col("params_text"), F.lit("\n"))
    body = F.concat(
        _check_text(), F.coalesce(column_line, F.lit("")), F.coalesce(params_line, F.lit("")), _samples_section())
    named = located.join(params, assigned, "left").drop("__check", "__table", "__column")
    return _with_samples(named, samples).select(
        "result_id", "run_id", "check_id", _table_name().alias("table_fqn"), body.alias("report"))
