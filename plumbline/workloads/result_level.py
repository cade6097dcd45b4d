"""Check runs, profiles, health scores, views and dashboard queries."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from plumbline.config.library import CHECKS, THRESHOLD_VALUES
from plumbline.config.specs import resolve_checks, spec
from plumbline.operators import metrics, schema_checks
from plumbline.plans import carried_profiles, dashboards, engine, health, incremental, lifecycle, profiling
from plumbline.plans.binding import TableContext
from plumbline.session import scratch_path
from plumbline.sources.store import ResultStore
from plumbline.streaming import feeds
from plumbline.workloads import derive as d
from plumbline.workloads.registry import workload

AS_OF = dt.datetime(2024, 1, 31)

# Per table: check, column, parameters, and the failure count in SQL.
RUN_CHECKS = {
    "customer": [
        (1, "c_name", dict(record_id="c_custkey"), "COUNT(*) FILTER (c_name IS NULL)"),
        (6, "c_acctbal", dict(record_id="c_custkey", min_value=-500, max_value=9500),
         "COUNT(*) FILTER (c_acctbal < -500 OR c_acctbal > 9500)"),
        (8, "c_name", dict(record_id="c_custkey", pattern="Customer#0000[0-9]+"),
         "COUNT(*) FILTER (NOT regexp_full_match(c_name, 'Customer#0000[0-9]+'))"),
        (9, "c_mktsegment", dict(record_id="c_custkey", allowed_values="'BUILDING','MACHINERY','HOUSEHOLD','FURNITURE'"),
         "COUNT(*) FILTER (c_mktsegment NOT IN ('BUILDING','MACHINERY','HOUSEHOLD','FURNITURE'))"),
        (20, "c_acctbal", dict(record_id="c_custkey"), "COUNT(*) FILTER (c_acctbal < 0)"),
        (2, "c_custkey", dict(record_id="c_custkey"),
         "(SELECT COUNT(*) FROM (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING COUNT(*) > 1))"),
        (15, "c_mktsegment", dict(max_pct="20.1"),
         "(SELECT COUNT(*) FROM (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING COUNT(*) * 100.0 / (SELECT COUNT(*) FROM customer) > 20.1))"),
    ],
    "orders": [
        (10, "o_orderdate", dict(record_id="o_orderkey", rule_expression="o_orderdate > TIMESTAMP_NTZ'2001-07-15 00:00:00'"),
         "COUNT(*) FILTER (o_orderdate > TIMESTAMP '2001-07-15 00:00:00')"),
        (11, "o_orderstatus,o_orderpriority",
         dict(record_id="o_orderkey", rule_expression="o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
         "COUNT(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')"),
        (12, "o_orderdate", dict(record_id="o_orderkey", timestamp_column="o_orderdate", max_staleness_days=10000),
         "COUNT(*) FILTER (date_diff('day', o_orderdate, TIMESTAMP '2024-01-31') > 10000)"),
        (16, "o_totalprice", dict(record_id="o_orderkey", z_threshold="1.7"),
         "(SELECT COUNT(*) FROM orders, (SELECT AVG(o_totalprice) m, STDDEV_SAMP(o_totalprice) s FROM orders) WHERE ABS((o_totalprice - m) / s) > 1.7)"),
        (4, "o_custkey", dict(fk_column="o_custkey", parent_table="customer", pk_column="c_custkey"),
         "(SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))"),
        (23, None, dict(date_column="o_orderdate", group_column="o_orderpriority", group_value="5-LOW", amount_column="o_totalprice"),
         "(SELECT COUNT(*) FROM (SELECT o_orderdate FROM orders WHERE o_orderpriority = '5-LOW' GROUP BY 1 HAVING COUNT(DISTINCT o_totalprice) > 1))"),
        (18, "o_totalprice", dict(source_table="lineitem", src_date_col="l_shipdate", src_amount_col="l_quantity",
                                  tgt_date_col="o_orderdate", tgt_count_col="o_custkey", tgt_amount_col="o_totalprice"),
         "(SELECT COUNT(*) FROM orders JOIN (SELECT l_shipdate AS d, COUNT(*) AS c, SUM(l_quantity) AS s FROM lineitem "
         "WHERE l_shipdate IS NOT NULL GROUP BY 1) ON o_orderdate = d WHERE c <> o_custkey OR s <> o_totalprice)"),
        (22, "o_custkey", dict(id_column="o_orderkey", parent_column="o_custkey"),
         "(SELECT COUNT(*) FROM orders WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders)) + "
         "(SELECT COUNT(*) FROM orders a JOIN orders b ON a.o_orderkey = b.o_custkey AND a.o_custkey = b.o_orderkey)"),
    ],
    "region": [(17, None, dict(), "(SELECT COUNT(*) FROM region) + 2")],
    "lineitem": [
        (13, None, dict(record_id="l_orderkey", null_check_expression="l_discount = 0 AND l_tax = 0"),
         "COUNT(*) FILTER (l_discount = 0 AND l_tax = 0)"),
        (14, "l_discount", dict(record_id="l_orderkey", volume_column="l_discount", date_column="l_shipdate"),
         "COUNT(*) FILTER (l_discount = 0 AND l_shipdate IS NOT NULL)"),
        (21, "l_extendedprice", dict(record_id="l_orderkey", qty_column="l_quantity", price_column="l_linenumber",
                                     total_column="l_extendedprice", tolerance="90000"),
         "COUNT(*) FILTER (ABS(l_extendedprice - l_quantity * l_linenumber) > 90000)"),
        (3, None, dict(columns="l_orderkey, l_linenumber", where_clause="WHERE l_linestatus = 'O'"),
         "(SELECT COUNT(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2 HAVING COUNT(*) > 1))"),
        (99, "l_tax", dict(), None),
        (1, "l_no_such_column", dict(record_id="l_orderkey"), None),
    ],
    "part": [
        (7, "p_name", dict(record_id="p_partkey", min_length=9, max_length=12),
         "COUNT(*) FILTER (LENGTH(p_name) < 9 OR LENGTH(p_name) > 12)"),
        (24, "p_size", dict(record_id="p_partkey", rule_expression="p_size < 3"), "COUNT(*) FILTER (p_size < 3)"),
        (2, "p_name", dict(record_id="p_name"),
         "(SELECT COUNT(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING COUNT(*) > 1))"),
        (19, "p_name", dict(file_column="p_name"),
         "(SELECT COUNT(*) FROM (SELECT p_name FROM part GROUP BY 1 HAVING COUNT(*) > 1))"),
    ],
    "events": [
        (5, "props", dict(record_id="event_id", expected_type="NUMBER", filter="event_type = 'view'"),
         "COUNT(*) FILTER (event_type = 'view' AND TRY_CAST(props AS DECIMAL(38,0)) IS NULL)"),
        (25, "event_type", dict(record_id="event_id", cdc_op_column="event_type",
                                rule_expression="event_type NOT IN ('view','click','signup')"),
         "COUNT(*) FILTER (event_type NOT IN ('view','click','signup'))"),
        (25, "user_id", dict(record_id="event_id", cdc_op_column="event_type", duplicate_keys="user_id, event_type"),
         "(SELECT COUNT(*) FROM events WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events "
         "GROUP BY user_id, event_type HAVING COUNT(*) > 1))"),
    ],
    "documents": [
        (7, "text", dict(record_id="doc_id", min_length=40, max_length=5000),
         "COUNT(*) FILTER (LENGTH(text) < 40 OR LENGTH(text) > 5000)"),
        (3, None, dict(columns="text"),
         "(SELECT COUNT(*) FROM (SELECT text FROM documents GROUP BY text HAVING COUNT(*) > 1))"),
    ],
}
KNOWN = {c[0] for c in CHECKS}


def run_specs():
    return [
        spec(check, table, column, **params)
        for table, checks in RUN_CHECKS.items() for check, column, params, _ in checks if check in KNOWN
    ]


def _quoted(text):
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _run_sql() -> str:
    limits = {t[0]: t for t in THRESHOLD_VALUES}
    parts = []
    for table, checks in RUN_CHECKS.items():
        for check, column, _, counted in checks:
            if check not in KNOWN:
                continue
            _, name, _, severity, weight, _ = next(c for c in CHECKS if c[0] == check)
            _, _, warn, fail = limits[check]
            parts.append(
                f"SELECT {check} AS check_id, {_quoted(name)} AS check_name, '{table}' AS target_table, "
                f"{_quoted(column)} AS target_column, COUNT(*) AS total_rows, {counted or 0} AS failure_count, "
                f"{'TRUE' if counted is None else 'FALSE'} AS broken, {warn} AS warn, {fail} AS fail, "
                f"'{severity}' AS severity, CAST({weight} AS DOUBLE) AS weight FROM {table}"
            )
    return "counted AS (" + "\nUNION ALL ".join(parts) + """),
checked AS (SELECT CAST(check_id AS BIGINT) AS check_id, check_name, target_table, CAST(target_column AS VARCHAR) AS target_column,
  CASE WHEN broken THEN 'ERROR' WHEN failure_count = 0 THEN 'PASS' WHEN failure_count >= fail THEN 'FAIL'
    WHEN failure_count >= warn THEN 'WARNING' ELSE 'FAIL' END AS check_status,
  CAST(total_rows AS BIGINT) AS total_rows, CAST(failure_count AS BIGINT) AS failure_count,
  FLOOR(failure_count * CAST(10000 AS DOUBLE) / total_rows + 0.5) / 10000 AS failure_pct, severity, weight FROM counted)"""


CHECKED = _run_sql()


def region_snapshots(t):
    """A stored schema of the regions whose columns bear the regions' names."""
    return t["region"].select(F.lit("region").alias("table_name"), F.col("r_name").alias("column_name"))


def run_plans(t):
    return [
        engine.plan_table(TableContext(t, table, AS_OF, region_snapshots(t)), [s for s in run_specs() if s.target_table == table], table)
        for table in RUN_CHECKS
    ]


def run_results(t):
    out = None
    for plan in run_plans(t):
        rows = engine.check_results(plan)
        out = rows if out is None else out.unionByName(rows)
    return out


def run_failures(t):
    out = None
    for plan in run_plans(t):
        rows = engine.failed_records(plan)
        out = rows if out is None else out.unionByName(rows)
    return out


def plain(df, *columns):
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


@workload("engine_run", f"""WITH {CHECKED}
SELECT check_id, check_name, target_table, target_column, check_status, total_rows, failure_count, failure_pct,
  severity, weight FROM checked""")
def engine_run(t):
    return plain(run_results(t), "failure_pct", "weight").select(
        "check_id", "check_name", "target_table", "target_column", "check_status", "total_rows", "failure_count",
        "failure_pct", "severity", "weight")


@workload("run_summary", f"""WITH {CHECKED}
SELECT target_table, COUNT(*) AS total_checks, COUNT(*) FILTER (check_status = 'PASS') AS passed_checks,
  COUNT(*) FILTER (check_status IN ('FAIL','WARNING')) AS failed_checks,
  CASE WHEN COUNT(*) FILTER (check_status = 'ERROR') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS overall_status
FROM checked GROUP BY target_table""")
def run_summary(t):
    now = F.lit(None).cast("timestamp_ntz")
    return engine.run_summary(run_results(t), now, now).select(
        "target_table", "total_checks", "passed_checks", "failed_checks", "overall_status")


@workload("run_health", f"""WITH {CHECKED}
SELECT target_table, ROUND(SUM(CASE check_status WHEN 'PASS' THEN weight WHEN 'WARNING' THEN weight * 0.5 ELSE 0 END) * 100 / SUM(weight), 2) AS health_score,
  COUNT(*) AS total_checks, COUNT(*) FILTER (severity = 'CRITICAL' AND check_status <> 'PASS') AS critical_failures
FROM checked WHERE check_status <> 'ERROR' GROUP BY target_table""")
def run_health(t):
    return plain(health.health_scores(run_results(t)), "health_score").select(
        "target_table", "health_score", "total_checks", "critical_failures")


def full_run(t):
    """Every table in schema public, and the customers once more in another schema with fewer checks."""
    specs = run_specs()
    specs += [replace(s, target_schema="Archive") for s in specs if s.target_table == "customer" and s.check_id in (1, 20)]
    contexts = engine.contexts_of(specs, lambda database, schema: t, AS_OF, region_snapshots(t))
    return engine.run_all(t.spark, contexts, specs)


ARCHIVED = "target_table = 'customer' AND check_id IN (1, 20)"


@workload("run_all", f"""WITH {CHECKED}
SELECT check_id, check_name, target_table, target_column, check_status, total_rows, failure_count, failure_pct, severity, weight,
  CAST(CASE WHEN twice THEN 2 ELSE 1 END AS INTEGER) AS runs FROM (SELECT *, {ARCHIVED} AS twice FROM checked)""")
def run_all(t):
    """The two runs of one table differ in nothing but their run."""
    names = ["check_id", "check_name", "target_table", "target_column", "check_status", "total_rows", "failure_count",
             "failure_pct", "severity", "weight"]
    return plain(full_run(t).results, "failure_pct", "weight").groupBy(*names).agg(
        F.count_distinct("run_id").cast("int").alias("runs"))


@workload("run_log", f"""WITH {CHECKED}, placed AS (SELECT *, 'public' AS target_schema FROM checked
  UNION ALL SELECT *, 'Archive' FROM checked WHERE {ARCHIVED})
SELECT 'main' AS target_database, target_schema, target_table, COUNT(*) AS total_checks,
  COUNT(*) FILTER (check_status = 'PASS') AS passed_checks, COUNT(*) FILTER (check_status IN ('FAIL','WARNING')) AS failed_checks,
  CASE WHEN COUNT(*) FILTER (check_status = 'ERROR') > 0 THEN 'COMPLETED_WITH_ERRORS' ELSE 'COMPLETED' END AS overall_status,
  'MANUAL' AS triggered_by, CAST(1 AS BIGINT) AS runs FROM placed GROUP BY target_schema, target_table""")
def run_log(t):
    """As stored and read back; a repeated run replaces itself."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    run = full_run(t)
    for _ in range(2):
        store.replace_runs("run_log", run.run_log)
    keys = ["target_database", "target_schema", "target_table", "total_checks", "passed_checks", "failed_checks",
            "overall_status", "triggered_by"]
    return store.read("run_log").groupBy(*keys).agg(F.count_distinct("run_id").alias("runs"))


def _first_hundred(check, table, record, value, column, condition):
    name = next(c[1] for c in CHECKS if c[0] == check)
    return (
        f"SELECT * FROM (SELECT CAST({check} AS BIGINT) AS check_id, '{table}' AS target_table, "
        f"CAST({record} AS VARCHAR) AS record_identifier, '{column}' AS column_name, "
        f"COALESCE(CAST({value} AS VARCHAR), 'N/A') AS failed_value, '{name}' AS failure_reason FROM {table} "
        f"WHERE {condition} ORDER BY record_identifier, failed_value LIMIT 100)"
    )


def _sampled(check, table, column, rows):
    """The first hundred of rows (r, v), identifier and value."""
    name = next(c[1] for c in CHECKS if c[0] == check)
    return (
        f"SELECT * FROM (SELECT CAST({check} AS BIGINT) AS check_id, '{table}' AS target_table, CAST(r AS VARCHAR) AS record_identifier, "
        f"'{column}' AS column_name, COALESCE(CAST(v AS VARCHAR), 'N/A') AS failed_value, '{name}' AS failure_reason "
        f"FROM ({rows}) ORDER BY record_identifier, failed_value LIMIT 100)"
    )


FAR = "ABS((o_totalprice - (SELECT AVG(o_totalprice) FROM orders)) / (SELECT STDDEV_SAMP(o_totalprice) FROM orders)) > 1.7"


@workload("engine_samples", " UNION ALL ".join([
    _first_hundred(8, "customer", "c_custkey", "c_name", "c_name", "NOT regexp_full_match(c_name, 'Customer#0000[0-9]+')"),
    _first_hundred(10, "orders", "o_orderkey", "NULL", "o_orderdate", "o_orderdate > TIMESTAMP '2001-07-15 00:00:00'"),
    _first_hundred(11, "orders", "o_orderkey", "NULL", "o_orderstatus,o_orderpriority",
                   "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    _first_hundred(12, "orders", "o_orderkey", "o_orderdate", "o_orderdate",
                   "date_diff('day', o_orderdate, TIMESTAMP '2024-01-31') > 10000"),
    _first_hundred(16, "orders", "o_orderkey", "o_totalprice", "o_totalprice", FAR),
    _first_hundred(13, "lineitem", "l_orderkey", "NULL", "N/A", "l_discount = 0 AND l_tax = 0"),
    _first_hundred(14, "lineitem", "l_orderkey", "l_discount", "l_discount", "l_discount = 0 AND l_shipdate IS NOT NULL"),
    _first_hundred(21, "lineitem", "l_orderkey", "l_extendedprice", "l_extendedprice",
                   "ABS(l_extendedprice - l_quantity * l_linenumber) > 90000"),
    _first_hundred(5, "events", "event_id", "props", "props",
                   "event_type = 'view' AND TRY_CAST(props AS DECIMAL(38,0)) IS NULL"),
    _first_hundred(25, "events", "event_id", "event_type", "event_type", "event_type NOT IN ('view','click','signup')"),
    _first_hundred(25, "events", "event_id", "event_type", "user_id", "(user_id, event_type) IN (SELECT (user_id, event_type) "
                   "FROM events GROUP BY user_id, event_type HAVING COUNT(*) > 1)"),
    _first_hundred(7, "documents", "doc_id", "text", "text", "LENGTH(text) < 40 OR LENGTH(text) > 5000"),
    _first_hundred(6, "customer", "c_custkey", "c_acctbal", "c_acctbal", "c_acctbal < -500 OR c_acctbal > 9500"),
    _first_hundred(9, "customer", "c_custkey", "c_mktsegment", "c_mktsegment", "c_mktsegment = 'AUTOMOBILE'"),
    _first_hundred(20, "customer", "c_custkey", "c_acctbal", "c_acctbal", "c_acctbal < 0"),
    _first_hundred(7, "part", "p_partkey", "p_name", "p_name", "LENGTH(p_name) < 9 OR LENGTH(p_name) > 12"),
    _first_hundred(24, "part", "p_partkey", "NULL", "p_size", "p_size < 3"),
    _first_hundred(2, "part", "p_name", "NULL", "p_name",
                   "p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING COUNT(*) > 1)")
    .replace("SELECT CAST(2 ", "SELECT DISTINCT CAST(2 "),
    _first_hundred(19, "part", "p_name", "p_name", "p_name",
                   "p_name IN (SELECT p_name FROM part GROUP BY 1 HAVING COUNT(*) > 1)")
    .replace("SELECT CAST(19 ", "SELECT DISTINCT CAST(19 "),
    _first_hundred(4, "orders", "o_custkey", "o_custkey", "o_custkey", "o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    _sampled(17, "region", "N/A", "SELECT c AS r, 'ADDED' AS v FROM (VALUES ('r_regionkey'), ('r_name')) t(c) "
             "WHERE c NOT IN (SELECT r_name FROM region) UNION ALL SELECT r_name, 'REMOVED' FROM region "
             "WHERE r_name NOT IN ('r_regionkey', 'r_name')"),
    _sampled(18, "orders", "o_totalprice", "SELECT o_orderdate AS r, NULL AS v FROM orders JOIN (SELECT l_shipdate AS d, COUNT(*) AS c, "
             "SUM(l_quantity) AS s FROM lineitem WHERE l_shipdate IS NOT NULL GROUP BY 1) ON o_orderdate = d "
             "WHERE c <> o_custkey OR s <> o_totalprice"),
    _sampled(22, "orders", "o_custkey", "SELECT o_orderkey AS r, 'ORPHAN' AS v FROM orders WHERE o_custkey NOT IN (SELECT o_orderkey FROM orders) "
             "UNION ALL SELECT a.o_orderkey, 'CIRCULAR' FROM orders a JOIN orders b ON a.o_orderkey = b.o_custkey AND a.o_custkey = b.o_orderkey"),
    _sampled(23, "orders", "N/A", "SELECT o_orderdate AS r, '5-LOW' AS v FROM orders WHERE o_orderpriority = '5-LOW' AND o_orderdate IS NOT NULL "
             "GROUP BY 1 HAVING COUNT(DISTINCT o_totalprice) > 1"),
]))
def engine_samples(t):
    """All checks whose failing records have an identifier, those that compare tables or rows included."""
    return run_failures(t).select(
        "check_id", "target_table", "record_identifier", "column_name", "failed_value", "failure_reason")


@workload("resolve_checks", f"""WITH {d.LIBRARY}, {d.ASSIGNMENTS}, {d.THRESHOLDS}
SELECT a.assignment_id, a.check_id, a.target_table, l.check_name, l.severity, l.weight, t.warning_value, t.fail_value
FROM assignments a JOIN library l ON a.check_id = l.check_id AND l.is_active
LEFT JOIN thresholds t ON a.check_id = t.check_id AND t.is_active WHERE a.is_active""")
def resolved(t):
    return resolve_checks(d.assignments(t), d.library(t), d.thresholds(t)).select(
        "assignment_id", "check_id", "target_table", "check_name", "severity", "weight", "warning_value", "fail_value")


# Profiles

def _column_sql(table, column, kind, numeric):
    text = f"CAST({column} AS VARCHAR)"
    mean = f"ROUND(AVG({column}), 4)" if numeric else "CAST(NULL AS DOUBLE)"
    median = f"ROUND(MEDIAN({column}), 4)" if numeric else "CAST(NULL AS DOUBLE)"
    return (
        f"SELECT '{column}' AS column_name, '{kind}' AS data_type, COUNT(*) AS row_count, "
        f"COUNT(*) - COUNT({column}) AS null_count, ROUND((COUNT(*) - COUNT({column})) * 100.0 / COUNT(*), 4) AS null_pct, "
        f"COUNT(DISTINCT {column}) AS distinct_count, MIN({text}) AS min_value, MAX({text}) AS max_value, "
        f"CAST({mean} AS DOUBLE) AS mean, CAST({median} AS DOUBLE) AS median FROM {table}"
    )


CUSTOMER_COLUMNS = [
    ("c_custkey", "long", True), ("c_name", "string", False), ("c_nationkey", "integer", True),
    ("c_acctbal", "double", True), ("c_mktsegment", "string", False),
]
ORDER_COLUMNS = [
    ("o_orderkey", "long", True), ("o_custkey", "long", True), ("o_orderstatus", "string", False),
    ("o_totalprice", "double", True), ("o_orderdate", "timestamp_ntz", False), ("o_orderpriority", "string", False),
]
STATISTICS = ["column_name", "data_type", "row_count", "null_count", "null_pct", "distinct_count", "min_value",
              "max_value", "mean", "median"]


@workload("profile_columns", " UNION ALL ".join(_column_sql("customer", *c) for c in CUSTOMER_COLUMNS))
def profile_columns(t):
    return profiling.column_profiles(t["customer"], signed_zeros=True).select(*STATISTICS)


@workload("profile_orders", " UNION ALL ".join(_column_sql("orders", *c) for c in ORDER_COLUMNS))
def profile_orders(t):
    return profiling.column_profiles(t["orders"], signed_zeros=True).select(*STATISTICS)


@workload("profile_flags", f"""WITH {d.FLAGGED}, picked AS (SELECT flag, l_quantity FROM flagged)
{_column_sql("picked", "flag", "string", False)} UNION ALL {_column_sql("picked", "l_quantity", "double", True)}""")
def profile_flags(t):
    return profiling.column_profiles(d.flagged_lines(t).select("flag", "l_quantity"), signed_zeros=True).select(*STATISTICS)


def _top_sql(table, column):
    return (
        f"SELECT '{column}' AS column_name, string_agg(v || '=' || n, ',' ORDER BY n DESC, v) AS top FROM ("
        f"SELECT CAST({column} AS VARCHAR) AS v, COUNT(*) AS n FROM {table} WHERE {column} IS NOT NULL GROUP BY v "
        f"ORDER BY n DESC, v LIMIT 5)"
    )


@workload("profile_top5", " UNION ALL ".join(_top_sql("orders", c[0]) for c in ORDER_COLUMNS))
def profile_top5(t):
    listed = F.transform("top_values", lambda e: F.concat_ws("=", e["value"], e["count"]))
    counts = profiling.value_counts(t["orders"], t["orders"].columns)
    return profiling.top_values(t["orders"], counts).select(
        "column_name", F.array_join(listed, ",").alias("top"))


DOCUMENT_COLUMNS = [("doc_id", "long", True), ("text", "string", False), ("lang", "string", False),
                    ("source", "string", False), ("n_chars", "long", True)]


def _typed_sql(table, column):
    return (f"SELECT '{column}' AS column_name, CAST(MIN({column}) AS VARCHAR) AS typed_min, "
            f"CAST(MAX({column}) AS VARCHAR) AS typed_max FROM {table}")


def listed_values():
    return F.array_join(F.transform("top_values", lambda e: F.concat_ws("=", e["value"], e["count"])), ",")


@workload("profile_documents", "SELECT * FROM (" + " UNION ALL ".join(_column_sql("documents", *c) for c in DOCUMENT_COLUMNS)
          + ") JOIN (" + " UNION ALL ".join(_top_sql("documents", c[0]) for c in DOCUMENT_COLUMNS)
          + ") USING (column_name) JOIN (" + " UNION ALL ".join(_typed_sql("documents", c[0]) for c in DOCUMENT_COLUMNS)
          + ") USING (column_name)")
def profile_documents(t):
    return profiling.column_profiles(t["documents"]).select(
        *STATISTICS, listed_values().alias("top"), "typed_min", "typed_max")


# Keys beyond 2**53, which no double tells apart.
BIG = "1152921504606846976 + o_orderkey * 3"


@workload("profile_big_keys", f"""WITH ranked AS (SELECT CAST({BIG} AS DECIMAL(38,0)) AS k,
  ROW_NUMBER() OVER (ORDER BY o_orderkey) AS place, COUNT(*) OVER () AS n FROM orders)
SELECT 'k' AS column_name, CAST(MIN(k) AS VARCHAR) AS typed_min, CAST(MAX(k) AS VARCHAR) AS typed_max,
  (SELECT CAST((MIN(k) + MAX(k)) * 0.5 AS DOUBLE) FROM (SELECT k - 1152921504606846976 AS k FROM ranked
    WHERE place IN ((n + 1) // 2, n // 2 + 1))) AS median FROM ranked""")
def profile_big_keys(t):
    keys = t["orders"].select((F.lit(1152921504606846976) + F.col("o_orderkey") * 3).alias("k"))
    return profiling.column_profiles(keys).select(
        "column_name", "typed_min", "typed_max", (F.col("typed_median").cast("decimal(38,1)") - F.lit(1152921504606846976)).cast("double").alias("median"))


@workload("profile_dist", f"""WITH {d.FLAGGED} SELECT 'flag' AS column_name, COALESCE(flag, '<NULL>') AS value_or_bucket,
  COUNT(*) AS record_count, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM lineitem), 4) AS percentage
FROM flagged GROUP BY flag
UNION ALL SELECT 'l_linestatus', l_linestatus, COUNT(*), ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM lineitem), 4)
FROM lineitem GROUP BY l_linestatus
UNION ALL SELECT 'l_returnflag', l_returnflag, COUNT(*), ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM lineitem), 4)
FROM lineitem GROUP BY l_returnflag""")
def profile_dist(t):
    return profiling.distributions(d.flagged_lines(t))


@workload("profile_embeddings", """SELECT 'vec_id' AS column_name, 'long' AS data_type, COUNT(*) AS row_count,
  CAST(NULL AS VARCHAR) AS pattern_summary FROM embeddings
UNION ALL SELECT 'label', 'integer', COUNT(*), NULL FROM embeddings
UNION ALL SELECT 'embedding', 'array', NULL, 'ERROR: cannot profile array' FROM (SELECT COUNT(*) FROM embeddings)""")
def profile_embeddings(t):
    return profiling.column_profiles(t["embeddings"]).select("column_name", "data_type", "row_count", "pattern_summary")


@workload("profile_receipt", """SELECT 'orders' AS table_name, COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count,
  'COMPLETED' AS status, TRUE AS same_id FROM orders""")
def profile_receipt(t):
    receipt = profiling.profile_receipt(profiling.table_profile(t["orders"], "orders", AS_OF))
    parsed = F.from_json("receipt", "profile_id string, `table` string, rows bigint, columns bigint, status string")
    return receipt.select("profile_id", parsed.alias("r")).select(
        F.col("r.table").alias("table_name"), F.col("r.rows").alias("row_count"),
        F.col("r.columns").alias("column_count"), "r.status", (F.col("profile_id") == F.col("r.profile_id")).alias("same_id"))


@workload("profile_twice", """SELECT 'column_profiles' AS stored, CAST(6 AS BIGINT) AS n, COUNT(*) AS row_count FROM orders
UNION ALL SELECT 'table_profiles', 1, COUNT(*) FROM orders
UNION ALL SELECT 'schema_snapshots', 6, (SELECT COUNT(*) FROM orders)
UNION ALL SELECT 'distribution_snapshots', (SELECT COUNT(DISTINCT o_orderstatus) + COUNT(DISTINCT o_orderpriority) FROM orders),
  (SELECT COUNT(*) FROM orders)""")
def profile_twice(t):
    """A profile that is repeated for the same moment takes the place of the first."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    for _ in range(2):
        lifecycle.profile_and_store(store, TableContext(t, "orders", AS_OF))
    total = store.read("table_profiles").select("row_count")
    parts = [store.read(name).agg(F.count(F.lit(1)).alias("n")).withColumn("stored", F.lit(name)) for name in (
        "column_profiles", "table_profiles", "schema_snapshots", "distribution_snapshots")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("row_count", total.scalar())


@workload("schema_columns", """SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position,
  CASE data_type WHEN 'BIGINT' THEN 'long' WHEN 'INTEGER' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double'
    WHEN 'FLOAT[]' THEN 'array' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END AS data_type
FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem', 'embeddings', 'events')""")
def schema_columns(t):
    """What the files of the given tables say about their columns."""
    out = None
    for name in ("orders", "lineitem", "embeddings", "events"):
        rows = schema_checks.schema_frame(t.spark, t[name].schema, name)
        out = rows if out is None else out.unionByName(rows)
    return out.select("table_name", "column_name", "ordinal_position", "data_type")


@workload("profile_table", """SELECT 'orders' AS table_name, COUNT(*) AS row_count, CAST(6 AS BIGINT) AS column_count,
  'COMPLETED' AS profile_status FROM orders
UNION ALL SELECT 'lineitem', COUNT(*), 11, 'COMPLETED' FROM lineitem""")
def profile_table(t):
    profiles = profiling.table_profile(t["orders"], "orders", AS_OF).unionByName(
        profiling.table_profile(t["lineitem"], "lineitem", AS_OF))
    return profiles.select("table_name", "row_count", "column_count", "profile_status")


def _share_sql(column, condition):
    return (f"SELECT {column} AS v, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM orders WHERE {condition}), 4) AS p "
            f"FROM orders WHERE {condition} GROUP BY {column}")


EARLY, LATE = "o_orderdate < TIMESTAMP '1998-01-01'", "o_orderdate >= TIMESTAMP '1998-01-01'"


@workload("ext2_snapshot_shift", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT(*) AS buckets, ROUND(SUM(ABS(COALESCE(n.p, 0) - COALESCE(b.p, 0))) / 200, 6) AS variation "
    f"FROM ({_share_sql(c, LATE)}) n FULL JOIN ({_share_sql(c, EARLY)}) b USING (v)" for c in ("o_orderstatus", "o_orderpriority")))
def ext2_snapshot_shift(t):
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    early = profiling.distributions(t["orders"].where(F.col("o_orderdate") < cut))
    late = profiling.distributions(t["orders"].where(F.col("o_orderdate") >= cut))
    return metrics.snapshot_shift(late, early)


# Health and views

@workload("health_score", f"WITH {d.SCORES} SELECT * FROM scores")
def health_score(t):
    return plain(d.scores(t), "health_score")


@workload("v_check_summary", f"""WITH {d.RUNS}
SELECT r.run_id, r.target_table, c.check_id, c.check_name, c.target_column, c.check_status, c.severity, c.total_rows,
  c.failure_count, c.failure_pct, CAST(c.weight AS DOUBLE) AS weight, c.execution_time_ms, c.error_message, r.run_start_time
FROM results c JOIN run_log r USING (run_id)""")
def v_check_summary(t):
    return plain(health.check_summary(d.results(t), d.run_rows(t)), "weight")


TABLE_HEALTH = d.SCORES + ", " + d.FAILED_RECORDS + """,
table_health AS (SELECT s.target_table, s.run_id, s.health_score, s.total_checks, s.passed_checks, s.failed_checks,
  s.total_checks - s.passed_checks - s.failed_checks AS warning_checks, s.critical_failures, s.high_failures,
  s.medium_failures, s.low_failures, COALESCE(f.n, 0) AS failed_record_count, r.overall_status, r.run_start_time
  FROM scores s JOIN run_log r USING (run_id)
  LEFT JOIN (SELECT run_id, COUNT(*) AS n FROM failed_records GROUP BY run_id) f USING (run_id))"""


def table_health(t):
    return health.table_health(d.scores(t), d.run_rows(t), d.failed_records(t))


@workload("v_table_health", f"WITH {TABLE_HEALTH} SELECT * FROM table_health")
def v_table_health(t):
    return plain(table_health(t), "health_score")


OVERALL = """SELECT ROUND(AVG(health_score), 2) AS overall_health_score, COUNT(DISTINCT target_table) AS tables_evaluated,
  CAST(SUM(total_checks) AS BIGINT) AS total_checks, CAST(SUM(passed_checks) AS BIGINT) AS passed_checks,
  CAST(SUM(failed_checks) AS BIGINT) AS failed_checks, CAST(SUM(warning_checks) AS BIGINT) AS warning_checks,
  CAST(SUM(failed_record_count) AS BIGINT) AS total_failed_records,
  CASE WHEN AVG(health_score) >= 90 THEN 'HEALTHY' WHEN AVG(health_score) >= 70 THEN 'WARNING'
    WHEN AVG(health_score) >= 50 THEN 'AT_RISK' ELSE 'CRITICAL' END AS overall_status,
  MAX(run_start_time) AS latest_run FROM table_health"""


def overall(t):
    return plain(health.overall_health(d.scores(t), d.run_rows(t), d.failed_records(t)), "overall_health_score")


@workload("v_overall", f"WITH {TABLE_HEALTH} {OVERALL}")
def v_overall(t):
    return overall(t)


@workload("q01_overall", f"""WITH {TABLE_HEALTH}, overall AS ({OVERALL})
SELECT *, CASE WHEN overall_health_score >= 80 THEN 'green' WHEN overall_health_score >= 50 THEN 'yellow' ELSE 'red' END AS light
FROM overall""")
def q01(t):
    return dashboards.overall_with_light(overall(t))


@workload("q02_table_health", f"""WITH {TABLE_HEALTH} SELECT target_table, health_score, total_checks, passed_checks,
  failed_checks, failed_record_count, overall_status FROM table_health""")
def q02(t):
    return plain(dashboards.tables_by_score(table_health(t)), "health_score")


@workload("q03_profiled_tables", f"""WITH {d.PROFILE_HISTORY}
SELECT DISTINCT database_name || '.' || schema_name || '.' || table_name AS table_fqn FROM history""")
def q03(t):
    return dashboards.profiled_tables(d.profile_history(t))


@workload("q04_latest_profile", f"""WITH {d.PROFILE_HISTORY}
SELECT row_count, column_count, profiled_at, profile_status FROM history WHERE table_name = 'click'
ORDER BY profiled_at DESC LIMIT 1""")
def q04(t):
    return dashboards.latest_profile(d.profile_history(t), "DW.web.click")


def stored(df, label):
    """Written to and read back from shared storage, as profiles are before they are shown."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def stored_profile(t):
    profile = profiling.column_profiles(t["customer"], signed_zeros=True)
    return stored(profiling.located(profile, "customer", AS_OF), "profile")


@workload("q05_columns", "SELECT * EXCLUDE (row_count) FROM (" + " UNION ALL ".join(
    _column_sql("customer", *c) for c in CUSTOMER_COLUMNS) + ")")
def q05(t):
    return dashboards.table_columns(stored_profile(t), "main.public.customer")


@workload("q06_distribution", """SELECT 'o_orderstatus' AS column_name, o_orderstatus AS value_or_bucket,
  COUNT(*) AS record_count, ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM orders), 4) AS percentage
FROM orders GROUP BY o_orderstatus""")
def q06(t):
    values = profiling.located(profiling.distributions(t["orders"]), "orders", AS_OF, "snapshot_at")
    return dashboards.table_distributions(stored(values, "values"), "main.public.orders", "o_orderstatus")


@workload("q07_catalog", f"""WITH {d.LIBRARY} SELECT check_id, check_name, category, description, severity, weight,
  CASE WHEN is_ai_check THEN 'Yes' ELSE 'No' END AS ai_enhanced,
  CASE WHEN is_active THEN 'Active' ELSE 'Inactive' END AS status FROM library WHERE category = 'Brand#12'""")
def q07(t):
    return dashboards.check_catalog(d.library(t), "Brand#12")


@workload("q08_recent_runs", f"""WITH {d.RUNS} SELECT run_id, target_table, overall_status, total_checks, passed_checks,
  failed_checks, run_start_time FROM run_log ORDER BY run_start_time DESC, run_id LIMIT 50""")
def q08(t):
    return dashboards.recent_runs(d.run_log(t))


@workload("q09_run_results", f"""WITH {d.RUNS} SELECT r.target_table, check_id, check_name, check_status, severity,
  failure_count FROM results c JOIN run_log r USING (run_id) WHERE run_id = 'R77'""")
def q09(t):
    return dashboards.run_results(health.check_summary(d.results(t), d.run_rows(t)), "R77")


# Runs at the grain of a line number, so that one run holds a share of all records.
@workload("q10_run_samples", """SELECT check_id, record_identifier, column_name, failed_value, failure_reason FROM (
  SELECT 'R' || l_linenumber AS run_id, l_suppkey AS check_id, CAST(l_partkey AS VARCHAR) AS record_identifier,
    l_linestatus AS column_name, CAST(l_orderkey AS VARCHAR) AS failed_value, l_returnflag AS failure_reason FROM lineitem)
WHERE run_id = 'R3' ORDER BY check_id, record_identifier, failed_value, column_name, failure_reason LIMIT 50""")
def q10(t):
    records = t["lineitem"].selectExpr(
        "concat('R', l_linenumber) AS run_id", "l_suppkey AS check_id", "CAST(l_partkey AS STRING) AS record_identifier",
        "l_linestatus AS column_name", "CAST(l_orderkey AS STRING) AS failed_value", "l_returnflag AS failure_reason")
    return dashboards.run_samples(records, "R3")


@workload("q11_profiles", f"""WITH {d.CACHE} SELECT analysis_id, target_table, model_used, status, created_at, ai_response
FROM cache WHERE analysis_type = 'PROFILE'""")
def q11(t):
    return dashboards.profile_analyses(d.analysis_cache(t))


@workload("q12_explanations", f"""WITH {d.CACHE}, {d.RESULTS}
SELECT a.analysis_id, a.check_id, a.target_table, a.model_used, a.created_at, a.ai_response,
  r.check_name, r.check_status, r.severity
FROM cache a LEFT JOIN results r ON a.run_id = r.run_id AND a.check_id = r.check_id
WHERE a.analysis_type = 'FAILURE_EXPLANATION'""")
def q12(t):
    return dashboards.explained_failures(d.analysis_cache(t), d.results(t))


@workload("q15_monitored", f"""WITH {d.ASSIGNMENTS}
SELECT DISTINCT target_database, target_schema, target_table FROM assignments WHERE is_active""")
def q15(t):
    return dashboards.monitored_list(d.assignments(t))


@workload("inc_monitored", f"""WITH {d.ASSIGNMENTS} SELECT DISTINCT
  target_database || '.' || target_schema || '.' || target_table AS table_fqn FROM assignments WHERE is_active""")
def inc_monitored(t):
    return incremental.monitored_tables(d.assignments(t))


@workload("q16_assignments", f"""WITH {d.ASSIGNMENTS}, {d.LIBRARY}
SELECT a.check_id, l.check_name, a.target_table, a.target_column, l.severity FROM assignments a
JOIN library l ON a.check_id = l.check_id WHERE a.is_active""")
def q16(t):
    return dashboards.active_assignments(d.assignments(t), d.library(t))


@workload("q17_thresholds", f"""WITH {d.THRESHOLDS}, {d.LIBRARY}
SELECT t.check_id, l.check_name, t.threshold_name, t.warning_value, t.fail_value FROM thresholds t
JOIN library l ON t.check_id = l.check_id""")
def q17(t):
    return dashboards.threshold_list(d.thresholds(t), d.library(t))


LATEST = dt.datetime(2001, 7, 31, 1)


@workload("inc_unscored", f"""WITH {d.RUNS} SELECT run_id FROM run_log
WHERE run_start_time >= TIMESTAMP '2001-07-31 01:00:00' - INTERVAL 2000 HOUR
  AND run_id NOT IN (SELECT run_id FROM results WHERE check_status <> 'ERROR')""")
def inc_unscored(t):
    return incremental.unscored_runs(d.run_log(t), d.scores(t), LATEST, 2000)


@workload("inc_unexplained", f"""WITH {d.RUNS}, {d.CACHE} SELECT run_id FROM run_log r
WHERE run_start_time >= TIMESTAMP '2001-07-31 01:00:00' - INTERVAL 40000 HOUR AND failed_checks > 0
  AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.run_id = r.run_id AND analysis_type = 'FAILURE_EXPLANATION')""")
def inc_unexplained(t):
    return incremental.unexplained_runs(d.run_log(t), d.analysis_cache(t), LATEST, 40000)


@workload("rerun_compare", f"""WITH {d.SCORES}, runs AS (
  SELECT r.*, s.health_score FROM run_log r LEFT JOIN (SELECT run_id, health_score FROM scores) s USING (run_id)),
newest AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY target_table ORDER BY run_start_time DESC, run_id DESC) AS place
  FROM runs WHERE run_start_time > TIMESTAMP '1998-07-01 00:00:00') WHERE place = 1),
paired AS (SELECT b.run_id AS original_run_id, n.run_id AS rerun_run_id, target_table, b.health_score AS original_health_score,
  n.health_score AS rerun_health_score, ROUND(COALESCE(n.health_score - b.health_score, 0), 2) AS score_change,
  b.failed_checks AS original_failed_checks, n.failed_checks AS rerun_failed_checks
  FROM runs b JOIN newest n USING (target_table)
  WHERE b.run_start_time <= TIMESTAMP '1998-07-01 00:00:00' AND b.health_score IS NOT NULL)
SELECT *, CASE WHEN score_change > 0.01 THEN 'IMPROVED' WHEN score_change < -0.01 THEN 'DEGRADED' ELSE 'UNCHANGED' END AS improvement_status
FROM paired""")
def rerun_compare(t):
    cutoff = F.lit("1998-07-01").cast("timestamp_ntz")
    return plain(health.score_changes(d.scores(t), d.run_log(t), cutoff),
                 "original_health_score", "rerun_health_score", "score_change")


# Writes

RUN_DAYS = """SELECT 'R' || l_linenumber AS run_id, CAST(l_linenumber AS BIGINT) AS check_id, l_returnflag AS check_status,
  l_partkey AS failure_count FROM lineitem"""


@workload("store_clear", """SELECT 'R' || l_linenumber AS run_id, COUNT(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1""")
def store_clear(t):
    """Append all runs, clear the table, append a part."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    rows = t["lineitem"].selectExpr(
        "concat('R', l_linenumber) AS run_id", "CAST(l_linenumber AS BIGINT) AS check_id",
        "l_returnflag AS check_status", "TIMESTAMP_NTZ'2024-01-31 00:00:00' AS created_at")
    store.append("check_results", rows)
    store.clear("check_results")
    store.append("check_results", rows.where("check_status = 'R'"))
    return store.read("check_results").groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))


@workload("store_replace", f"""WITH stored AS ({RUN_DAYS})
SELECT run_id, check_status, COUNT(*) AS n, CAST(SUM(failure_count) AS BIGINT) AS failures FROM (
  SELECT run_id, check_status, failure_count FROM stored WHERE run_id NOT IN ('R2', 'R5')
  UNION ALL SELECT run_id, 'X', failure_count + 1 FROM stored WHERE run_id IN ('R2', 'R5') AND check_status = 'A')
GROUP BY run_id, check_status""")
def store_replace(t):
    """Append all runs, replace two of them, read the table back."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    rows = t["lineitem"].selectExpr(
        "concat('R', l_linenumber) AS run_id", "CAST(l_linenumber AS BIGINT) AS check_id",
        "l_returnflag AS check_status", "l_partkey AS failure_count",
        "TIMESTAMP_NTZ'2024-01-31 00:00:00' AS created_at")
    store.append("check_results", rows)
    again = rows.where("run_id IN ('R2', 'R5') AND check_status = 'A'").withColumns(
        {"check_status": F.lit("X"), "failure_count": F.col("failure_count") + 1})
    store.replace_runs("check_results", again)
    return store.read("check_results").groupBy("run_id", "check_status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("failure_count").alias("failures"))


CHANGED = """v AS (SELECT 'R' || (o_custkey % 50) AS run_id, CAST(o_orderkey AS BIGINT) AS check_id, o_orderstatus AS check_status,
  CAST(o_custkey AS BIGINT) AS failure_count, o_custkey % 50 AS r FROM orders),
second AS (SELECT run_id, check_id, check_status, failure_count + CASE WHEN check_id % 3 = 0 THEN 1 ELSE 0 END AS failure_count, r
  FROM v WHERE r IN (3, 7) AND check_id % 5 <> 1)"""


@workload("store_changes", f"""WITH {CHANGED}
SELECT 1 AS drain, 'INSERT' AS change_type, run_id, check_id, check_status, failure_count FROM v
UNION ALL SELECT 2, 'DELETE', run_id, check_id, check_status, failure_count FROM v WHERE r IN (3, 7) AND check_id % 5 = 1
UNION ALL SELECT 2, 'UPDATE_BEFORE', run_id, check_id, check_status, failure_count FROM v
  WHERE r IN (3, 7) AND check_id % 5 <> 1 AND check_id % 3 = 0
UNION ALL SELECT 2, 'UPDATE_AFTER', run_id, check_id, check_status, failure_count FROM second WHERE check_id % 3 = 0
UNION ALL SELECT 3, 'DELETE', run_id, check_id, check_status, failure_count FROM second WHERE r = 7
UNION ALL SELECT 3, 'INSERT', 'N' || check_id, check_id, check_status, failure_count FROM v WHERE r = 1""")
def store_changes(t):
    """What a stream over stored results is told: all runs, then two of them again, then one gone and others new."""
    path = scratch_path(t.spark, "feed")
    store = ResultStore(t.spark, f"{path}/store")
    rows = t["orders"].selectExpr(
        "concat('R', o_custkey % 50) AS run_id", "CAST(o_orderkey AS BIGINT) AS check_id", "'orders' AS target_table",
        "o_orderstatus AS check_status", "CAST(o_custkey AS BIGINT) AS failure_count",
        "TIMESTAMP_NTZ'2024-01-31 00:00:00' AS created_at")

    def drain(k):
        feeds.write_batches(
            store.stream("check_results"), lambda batch: batch, f"{path}/out/drain={k}", f"{path}/state").awaitTermination()

    store.append("check_results", rows)
    drain(1)
    again = rows.where("run_id IN ('R3', 'R7') AND check_id % 5 <> 1").withColumn(
        "failure_count", F.col("failure_count") + F.when(F.col("check_id") % 3 == 0, 1).otherwise(0))
    store.replace_runs("check_results", again)
    drain(2)
    store.replace_runs("check_results", rows.limit(0), rows.where("run_id = 'R7'"))
    store.append("check_results", rows.where("run_id = 'R1'").withColumn("run_id", F.expr("concat('N', check_id)")))
    drain(3)
    return t.spark.read.parquet(f"{path}/out").select(
        "drain", "change_type", "run_id", "check_id", "check_status", "failure_count")


def _carried_line(column, numeric):
    mean = f"CAST(ROUND(AVG({column}), 4) AS DOUBLE)" if numeric else "CAST(NULL AS DOUBLE)"
    return (f"SELECT '{column}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({column}) AS null_count, "
            f"MIN(CAST({column} AS VARCHAR)) AS min_value, MAX(CAST({column} AS VARCHAR)) AS max_value, "
            f"CAST(MIN({column}) AS VARCHAR) AS typed_min, CAST(MAX({column}) AS VARCHAR) AS typed_max, {mean} AS mean, "
            f"TRUE AS distinct_close, {'TRUE' if numeric else 'CAST(NULL AS BOOLEAN)'} AS median_close FROM orders")


CARRIED = {"o_orderkey": True, "o_custkey": True, "o_orderstatus": False, "o_orderpriority": False, "o_totalprice": True}


@workload("profile_incremental", " UNION ALL ".join(_carried_line(c, n) for c, n in CARRIED.items()))
def profile_incremental(t):
    """Orders by month: all months are profiled, 1996 with half of its rows; then the months of 1996 again, with all."""
    store = ResultStore(t.spark, scratch_path(t.spark, "store"))
    orders = t["orders"].select(*CARRIED, F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    late = orders.where("month LIKE '1996%'")
    for k, rows in enumerate([orders.where("month NOT LIKE '1996%' OR o_orderkey % 2 = 0"), late]):
        carried_profiles.carry_on(store, rows, F.col("month"), "orders", AS_OF + dt.timedelta(hours=k))
    df = t["orders"].select(*CARRIED)
    merged = carried_profiles.carried_profile(store, df.schema, "orders")
    estimates = {r.column_name: r for r in merged.select("column_name", "distinct_count", "median").collect()}
    exact = df.agg(*[F.count_distinct(c).alias(f"d_{c}") for c in CARRIED], F.count(F.lit(1)).alias("n"), *[
        f(F.when(sign(F.col(c), F.lit(estimates[c].median)), 1)).alias(f"{name}_{c}") for c, n in CARRIED.items() if n
        for name, f, sign in (("below", F.count, lambda a, b: a < b), ("upto", F.count, lambda a, b: a <= b))]).first()
    distinct = median = F.lit(None).cast("boolean")
    for c, numeric in CARRIED.items():
        here = F.col("column_name") == c
        off = abs(estimates[c].distinct_count - exact[f"d_{c}"]) / exact[f"d_{c}"]
        distinct = F.when(here, F.lit(off <= 3 * carried_profiles.DISTINCT_ERROR)).otherwise(distinct)
        if numeric:
            close = (exact[f"below_{c}"] / exact.n <= 0.5 + 2 * carried_profiles.RANK_ERROR
                     and exact[f"upto_{c}"] / exact.n >= 0.5 - 2 * carried_profiles.RANK_ERROR)
            median = F.when(here, F.lit(close)).otherwise(median)
    return merged.select(
        "column_name", "row_count", "null_count", "min_value", "max_value", "typed_min", "typed_max", "mean",
        distinct.alias("distinct_close"), median.alias("median_close"))
