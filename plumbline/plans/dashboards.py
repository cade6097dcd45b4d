"""The read queries of the dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scoring import traffic_light
from plumbline.functions.text import bind, guard_query
from plumbline.operators.skew import keep_left
from plumbline.plans.remediation import EXPLANATION, PROFILE, badge
from plumbline.session import cut_lineage, scratch_path

RECENT_RUNS = 50
SAMPLES_SHOWN = 50
ROWS_SHOWN = 50


def overall_with_light(overall: DataFrame) -> DataFrame:
    """The light has its own limits (80 and 50), apart from those of the status band."""
    return overall.withColumn("light", traffic_light(F.col("overall_health_score")))


def tables_by_score(table_health: DataFrame) -> DataFrame:
    return table_health.select(
        "target_table", "health_score", "total_checks", "passed_checks", "failed_checks", "failed_record_count",
        "overall_status",
    ).orderBy(F.desc("health_score"))


def profiled_tables(table_profiles: DataFrame) -> DataFrame:
    name = F.concat_ws(".", "database_name", "schema_name", "table_name")
    return table_profiles.select(name.alias("table_fqn")).distinct().orderBy("table_fqn")


def _of_table(df: DataFrame, fqn: str) -> DataFrame:
    database, schema, table = fqn.split(".")
    return df.where(
        (F.col("database_name") == database) & (F.col("schema_name") == schema) & (F.col("table_name") == table)
    )


def latest_profile(table_profiles: DataFrame, fqn: str) -> DataFrame:
    return _of_table(table_profiles, fqn).select(
        "row_count", "column_count", "profiled_at", "profile_status"
    ).orderBy(F.desc("profiled_at")).limit(1)


def table_columns(column_profiles: DataFrame, fqn: str) -> DataFrame:
    return _of_table(column_profiles, fqn).orderBy(F.desc("profiled_at")).select(
        "column_name", "data_type", "null_count", "null_pct", "distinct_count", "min_value", "max_value",
        "mean", "median",
    )


def table_distributions(distributions: DataFrame, fqn: str, column: str | None = None) -> DataFrame:
    rows = _of_table(distributions, fqn)
    if column:
        rows = rows.where(F.col("column_name") == column)
    return rows.select("column_name", "value_or_bucket", "record_count", "percentage").orderBy(
        "column_name", F.desc("record_count"))


def check_catalog(library: DataFrame, category: str | None = None) -> DataFrame:
    rows = library.where(F.col("category") == category) if category else library
    return rows.select(
        "check_id", "check_name", "category", "description", "severity", "weight",
        F.when(F.col("is_ai_check"), "Yes").otherwise("No").alias("ai_enhanced"),
        F.when(F.col("is_active"), "Active").otherwise("Inactive").alias("status"),
    ).orderBy("check_id")


def recent_runs(run_log: DataFrame, limit: int = RECENT_RUNS) -> DataFrame:
    return run_log.select(
        "run_id", "target_table", "overall_status", "total_checks", "passed_checks", "failed_checks",
        "run_start_time",
    ).orderBy(F.desc("run_start_time"), "run_id").limit(limit)


def run_results(check_summary: DataFrame, run_id: str) -> DataFrame:
    return check_summary.where(F.col("run_id") == run_id).select(
        "target_table", "check_id", "check_name", "check_status", "severity", "failure_count"
    ).orderBy("check_id")


def run_samples(failed_records: DataFrame, run_id: str, limit: int = SAMPLES_SHOWN) -> DataFrame:
    return failed_records.where(F.col("run_id") == run_id).select(
        "check_id", "record_identifier", "column_name", "failed_value", "failure_reason"
    ).orderBy("check_id", "record_identifier", "failed_value", "column_name").limit(limit)


def profile_analyses(cache: DataFrame) -> DataFrame:
    return cache.where(F.col("analysis_type") == PROFILE).select(
        "analysis_id", "target_table", "model_used", "status", "created_at", "ai_response"
    ).orderBy(F.desc("created_at"))


def explained_failures(cache: DataFrame, results: DataFrame, table: str | None = None) -> DataFrame:
    """Explanations with their results; a check that ran twice on a table shows twice."""
    rows = cache.where(F.col("analysis_type") == EXPLANATION)
    if table:
        rows = rows.where(F.col("target_table") == table)
    known = results.select("run_id", "check_id", "check_name", "check_status", "severity")
    return keep_left(rows, known, ["run_id", "check_id"]).select(
        "analysis_id", "check_id", "target_table", "model_used", "created_at", "ai_response",
        "check_name", "check_status", "severity",
    ).orderBy(F.desc("created_at"))


def pending_list(pending: DataFrame) -> DataFrame:
    return pending.select(
        "recommendation_id", "check_id", "target_table", "safety_classification", "recommendation_status",
        "approval_status", "action_status", "created_at", badge(F.col("safety_classification")).alias("badge"),
    ).orderBy(F.desc("created_at"))


def reply_text(cache: DataFrame, analysis_id: str) -> DataFrame:
    return cache.where(F.col("analysis_id") == analysis_id).select("ai_response")


def history_list(history: DataFrame) -> DataFrame:
    return history.select(
        "recommendation_id", "check_id", "target_table", "safety_classification", "recommendation_status",
        "approval_status", "execution_status", "reviewer", "executed_at", "created_at",
    ).orderBy(F.desc("created_at"))


def monitored_list(assignments: DataFrame) -> DataFrame:
    return assignments.where("is_active").select(
        "target_database", "target_schema", "target_table"
    ).distinct().orderBy("target_table")


def active_assignments(assignments: DataFrame, library: DataFrame) -> DataFrame:
    return assignments.where("is_active").join(
        library.select("check_id", "check_name", "severity"), "check_id"
    ).select("check_id", "check_name", "target_table", "target_column", "severity").orderBy(
        "target_table", "check_id")


def threshold_list(thresholds: DataFrame, library: DataFrame) -> DataFrame:
    return thresholds.join(library.select("check_id", "check_name"), "check_id").select(
        "check_id", "check_name", "threshold_name", "warning_value", "fail_value"
    ).orderBy("check_id")


def run_query(spark: SparkSession, sql: str, approved: list[str], limit: int = ROWS_SHOWN) -> tuple[str, str | None, DataFrame | None]:
    """Run one generated read query over registered views if its guard accepts it.

    Returns status, message and at most ``limit`` rows; a failing query gives EXECUTION_ERROR. The relations that the
    query really reads, as its parsed form names them, are compared with the list as well: quoted
    names and comma joins pass no text pattern. The rows are fetched here, so that an error of a row is a status too.
    """
    verdict = spark.range(1).select(guard_query(F.lit(sql), approved).alias("v")).first().v
    if verdict.status != "ACCEPTED":
        return verdict.status, verdict.message, None
    try:
        for name in relations_read(spark, sql):
            if not is_approved(spark, name, approved):
                return "BLOCKED", f"unapproved object: {'.'.join(name)}", None
        rows = spark.sql(sql).limit(limit)
        return "SUCCESS", None, spark.createDataFrame(rows.collect(), rows.schema)
    except Exception as error:
        return "EXECUTION_ERROR", str(error), None


def is_approved(spark: SparkSession, name: tuple[str, ...], approved: list[str]) -> bool:
    """Whether the last part of a name is on the list and what stands before it is a database, not a file format."""
    if name[-1].upper() not in {a.upper() for a in approved}:
        return False
    return len(name) == 1 or _is_database(spark, name[:-1])


# Table functions that read no stored data, expressions that hold a query, and relations whose name is computed.
ROW_FUNCTIONS = {"RANGE", "EXPLODE", "EXPLODE_OUTER", "POSEXPLODE", "POSEXPLODE_OUTER", "INLINE", "INLINE_OUTER", "STACK", "JSON_TUPLE"}
SUBQUERIES = {"ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"}
COMPUTED = {"PlanWithUnresolvedIdentifier", "ExpressionWithUnresolvedIdentifier"}


def relations_read(spark: SparkSession, sql: str) -> list[tuple[str, ...]]:
    """The parts of the names of all tables and views that a query refers to, each name once.

    The session's own parser reads the query; what it found is walked with the common table expressions that are in
    scope. Such a name hides a relation of one part inside its own query block and those within, in the expressions that
    follow it, and in itself if it is recursive; nowhere else. Case counts as it does in the session. A name that is
    computed when the query runs counts as ``IDENTIFIER``, a table function as its name and a pair of brackets unless it only makes rows of its arguments.
    """
    found: dict[tuple[str, ...], None] = {}
    folded = str if spark.conf.get("spark.sql.caseSensitive") == "true" else str.upper

    def listed(seq) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def expression(e, scope: frozenset[str]) -> None:
        kind = e.getClass().getSimpleName()
        if kind in SUBQUERIES:
            plan(e.plan(), scope)
        if kind in COMPUTED:
            found["IDENTIFIER",] = None
        for child in listed(e.children()):
            expression(child, scope)

    def plan(node, scope: frozenset[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            for entry in listed(node.cteRelations()):
                name = frozenset([folded(entry._1())])
                plan(entry._2(), scope | name if node.allowRecursion() else scope)
                scope = scope | name
        elif kind == "UnresolvedRelation":
            name = tuple(listed(node.multipartIdentifier()))
            if len(name) > 1 or folded(name[0]) not in scope:
                found[name] = None
        elif kind == "UnresolvedTableValuedFunction":
            name = listed(node.name())
            if len(name) > 1 or name[0].upper() not in ROW_FUNCTIONS:
                found[(*name[:-1], f"{name[-1]}()")] = None
        elif kind == "WithWindowDefinition":
            for window in listed(node.windowDefinitions().values().toSeq()):
                expression(window, scope)
        elif kind in COMPUTED:
            found["IDENTIFIER",] = None
        for e in listed(node.expressions()):
            expression(e, scope)
        for child in listed(node.children()):
            plan(child, scope)

    plan(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), frozenset())
    return list(found)


# What quotes may mean something else beside, or a name may be a function's: such statements are parsed as they are.
UNMASKED = r"""["\\$]|--|/\*|``|`\s*\(|[rR]'|__name_"""
# Before a literal whose text the parser does not look into.
PLAIN_LITERAL = r"(?i)(?:(?:^|\W)SELECT\s*|[=<>]\s*|\WFROM\s+IDENTIFIER\s*\(\s*)\z"
PARSED = T.StructType().add("shape", "string").add("parts", T.ArrayType(T.StringType()))
SHAPES_AT_ONCE = 10_000


def _masked(sql: Column) -> Column:
    """``shape`` and ``names`` of a statement: quoted names are numbered and plain literals emptied of their text.

    Statements of one shape differ in such names and texts only. Names are numbered where no two of them, and none and
    a bare word, could be the same name in another case; a statement in which that or its quoting is in doubt is its own shape.
    """
    def of(pieces: Column) -> Column:
        # Between single quotes lies every second piece.
        quoted = F.transform(pieces, lambda p, i: F.when(
            (i % 2 == 1) & F.get(pieces, i - 1).rlike(PLAIN_LITERAL), F.lit("s")).otherwise(p))
        sound = F.forall(F.transform(pieces, lambda p, i: F.when(
            i % 2 == 1, ~F.contains(p, F.lit("`"))).otherwise(F.regexp_count(p, F.lit("`")) % 2 == 0)), lambda x: x)
        code = F.array_join(F.filter(pieces, lambda p, i: i % 2 == 0), " ")
        found = F.array_distinct(F.regexp_extract_all(code, F.lit("`([^`]+)`"), F.lit(1)))

        def numbered(names: Column) -> Column:
            bare = F.upper(F.regexp_replace(code, "`[^`]*`", " "))
            words = F.split(bare, "[^A-Z0-9_]+")
            apart = (F.size(F.array_distinct(F.transform(names, F.upper))) == F.size(names)) & F.forall(
                names, lambda n: ~F.when(n.rlike(r"\A[A-Za-z0-9_]+\z"), F.array_contains(words, F.upper(n))).otherwise(
                    F.contains(bare, F.upper(n))))
            shape = F.aggregate(
                F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), F.array_join(quoted, "'"),
                lambda text, e: F.replace(text, F.concat(F.lit("`"), e["n"], F.lit("`")),
                                          F.concat(F.lit("`__name_"), e["i"].cast("string"), F.lit("__`"))))
            whole = F.struct(sql.alias("shape"), F.array().cast("array<string>").alias("names"))
            safe = ~sql.rlike(UNMASKED) & (F.size(pieces) % 2 == 1) & sound & apart
            return F.when(safe, F.struct(shape.alias("shape"), names.alias("names"))).otherwise(whole)

        return bind(found, numbered)

    return bind(F.split(sql, "'"), of)


def relations_of(statements: DataFrame, keys: list[str], sql: str, approved: list[str]) -> DataFrame:
    """(keys, relation, approved): what :func:`relations_read` finds in each statement, for a table of statements.

    The session parses one statement of each shape; its relations are joined back to all statements of that shape. So the
    driver's work follows the number of shapes, and what it found passes it in parts of bounded size.
    """
    spark = statements.sparkSession
    marked = cut_lineage(statements.select(*keys, _masked(F.col(sql)).alias("m")).select(*keys, "m.*"), "statements")
    path, rows = scratch_path(spark, "relations"), []

    def keep() -> None:
        spark.createDataFrame(rows, PARSED).coalesce(1).write.mode("append").parquet(path)
        rows.clear()

    for row in marked.select("shape").distinct().toLocalIterator():
        rows += [(row.shape, list(name)) for name in relations_read(spark, row.shape)]
        if len(rows) >= SHAPES_AT_ONCE:
            keep()
    keep()
    number = r"\A__name_(\d+)__\z"
    parts = F.transform("parts", lambda p: F.coalesce(F.when(
        p.rlike(number), F.get("names", F.regexp_extract(p, number, 1).cast("int"))), p))
    found = marked.join(spark.read.schema(PARSED).parquet(path), "shape").select(*keys, parts.alias("parts"))
    listed = F.upper(F.element_at("parts", -1)).isin([a.upper() for a in approved])
    database = F.slice("parts", F.lit(1), F.size("parts") - 1)
    there = [
        list(row.name) for row in found.where(listed & (F.size("parts") > 1)).select(database.alias("name")).distinct().toLocalIterator()
        if _is_database(spark, row.name)]
    known = F.lit(False)
    for name in there:
        known = known | (database == F.array(*[F.lit(part) for part in name]))
    return found.select(*keys, F.array_join("parts", ".").alias("relation"), (
        listed & ((F.size("parts") == 1) | known)).alias("approved"))


def _is_database(spark: SparkSession, name) -> bool:
    return spark.catalog.databaseExists(".".join(f"`{part.replace('`', '``')}`" for part in name))
