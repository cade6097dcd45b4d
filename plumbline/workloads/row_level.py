"""Row checks and their metric forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import scoring
from plumbline.operators import metrics, row_checks
from plumbline.workloads import derive as d
from plumbline.workloads.registry import workload

LINE_ID = "concat(l_orderkey, '-', l_linenumber)"


def lines(t):
    return d.flagged_lines(t).withColumn("line_id", F.expr(LINE_ID))


LINES = f"lines AS (SELECT *, {LINE_ID} AS line_id, {d.FLAG} AS flag FROM lineitem)"


@workload("chk01_null", f"""WITH {LINES}
SELECT line_id AS record_id, 'flag' AS column_name FROM lines WHERE flag IS NULL""")
def chk01_null(t):
    return row_checks.null_values(lines(t), "flag", "line_id")


@workload("m01_missing", f"""WITH {LINES}
SELECT COUNT(*) AS total_rows, COUNT(*) FILTER (flag IS NULL OR TRIM(flag) = '') AS null_count,
  ROUND(COUNT(*) FILTER (flag IS NULL OR TRIM(flag) = '') * 100.0 / COUNT(*), 2) AS null_pct FROM lines""")
def m01_missing(t):
    return metrics.missing_ratio(lines(t), "flag")


def keyed_events(t):
    return t["events"].withColumn("ktext", F.expr(d.KTEXT_SPARK))


KEYED_EVENTS = f"keyed AS (SELECT *, {d.KTEXT_SQL} AS ktext FROM events)"


@workload("chk05_type", f"""WITH {KEYED_EVENTS}
SELECT event_id AS record_id, ktext AS failed_value FROM keyed
WHERE event_type <> 'view' AND ktext IS NOT NULL AND TRY_CAST(ktext AS DECIMAL(38,0)) IS NULL""")
def chk05_type(t):
    return row_checks.wrong_types(keyed_events(t), "ktext", "event_id", "NUMBER", "event_type <> 'view'")


@workload("m05_type", f"""WITH {KEYED_EVENTS}
SELECT ktext, 'string' AS actual_type FROM keyed
WHERE ktext IS NOT NULL AND TRY_CAST(ktext AS DECIMAL(38,0)) IS NULL""")
def m05_type(t):
    return metrics.type_violations(keyed_events(t), "ktext", "NUMBER")


@workload("chk06_range", """SELECT p_partkey AS record_id, p_retailprice AS failed_value FROM part
WHERE p_retailprice < 910 OR p_retailprice > 1040""")
def chk06_range(t):
    return row_checks.out_of_range(t["part"], "p_retailprice", "p_partkey", F.lit(910), F.lit(1040))


@workload("m06_range", """SELECT l_extendedprice, 'OUT_OF_RANGE' AS reason FROM lineitem
WHERE l_extendedprice < 1000 OR l_extendedprice > 90000""")
def m06_range(t):
    return metrics.out_of_range_reasons(t["lineitem"], "l_extendedprice", F.lit(1000), F.lit(90000))


@workload("chk07_len", """SELECT p_partkey AS record_id, p_name AS failed_value, LENGTH(p_name) AS actual_len
FROM part WHERE p_name IS NOT NULL AND (LENGTH(p_name) < 9 OR LENGTH(p_name) > 12)""")
def chk07_len(t):
    return row_checks.bad_lengths(t["part"], "p_name", "p_partkey", 9, 12).withColumn(
        "actual_len", F.col("actual_len").cast("bigint"))


@workload("chk07_text_len", """SELECT doc_id AS record_id, text AS failed_value, LENGTH(text) AS actual_len
FROM documents WHERE text IS NOT NULL AND (LENGTH(text) < 40 OR LENGTH(text) > 5000)""")
def chk07_text_len(t):
    return row_checks.bad_lengths(t["documents"], "text", "doc_id", 40, 5000).withColumn(
        "actual_len", F.col("actual_len").cast("bigint"))


@workload("chk08_regex", """SELECT p_partkey AS record_id, p_brand AS failed_value FROM part
WHERE p_brand IS NOT NULL AND NOT regexp_full_match(p_brand, 'Brand#1[0-9]?|Brand#2')""")
def chk08_regex(t):
    return row_checks.pattern_breaks(t["part"], "p_brand", "p_partkey", "Brand#1[0-9]?|Brand#2")


@workload("chk08_url", r"""SELECT page_id AS record_id, url AS failed_value FROM pages
WHERE url IS NOT NULL AND NOT regexp_full_match(url, 'https?://[a-z.]+\.example\.(com|org)/[a-z]{2}/[0-9]+')""")
def chk08_url(t):
    return row_checks.pattern_breaks(
        t["pages"], "url", "page_id", r"https?://[a-z.]+\.example\.(com|org)/[a-z]{2}/[0-9]+")


@workload("chk09_domain", f"""WITH {LINES}
SELECT line_id AS record_id, flag AS failed_value FROM lines WHERE flag NOT IN ('A','N','R') AND flag IS NOT NULL""")
def chk09_domain(t):
    return row_checks.outside_domain(lines(t), "flag", "line_id", ["A", "N", "R"])


@workload("m09_domain", f"""WITH {LINES}
SELECT flag, COUNT(*) AS cnt FROM lines WHERE flag NOT IN ('A','N','R') AND flag IS NOT NULL GROUP BY flag""")
def m09_domain(t):
    return metrics.domain_violations(lines(t), "flag", ["A", "N", "R"])


RULE = "l_returnflag = 'N' AND l_discount > 0.05 AND l_quantity > 40"


@workload("chk10_rule", f"SELECT l_orderkey AS record_id FROM lineitem WHERE {RULE}")
def chk10_rule(t):
    return row_checks.rule_violations(t["lineitem"], RULE, "l_orderkey")


@workload("chk10_future", """SELECT event_id AS record_id FROM events WHERE ts > TIMESTAMP '2024-01-25 00:00:00'""")
def chk10_future(t):
    as_of = d.AS_OF.replace(day=25)
    return row_checks.rule_violations(t["events"], "ts > CURRENT_TIMESTAMP()", "event_id", as_of)


HOLDS = "flag <> 'R' OR l_discount <= 0.03"


@workload("m10_rule", f"""WITH {LINES}
SELECT l_orderkey, l_linenumber, flag, l_discount FROM lines WHERE NOT ({HOLDS})""")
def m10_rule(t):
    return metrics.rule_breaches(lines(t), HOLDS, ["l_orderkey", "l_linenumber", "flag", "l_discount"])


@workload("chk11_cross", """SELECT l_orderkey AS record_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE l_shipdate < o_orderdate""")
def chk11_cross(t):
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return row_checks.rule_violations(joined, "l_shipdate < o_orderdate", "l_orderkey")


@workload("m11_cross", """SELECT l_returnflag, l_linestatus FROM lineitem
WHERE NOT (l_returnflag <> 'A' OR l_linestatus = 'F')""")
def m11_cross(t):
    return metrics.rule_breaches(
        t["lineitem"], "l_returnflag <> 'A' OR l_linestatus = 'F'", ["l_returnflag", "l_linestatus"])


@workload("chk12_fresh", """SELECT event_id AS record_id, ts AS failed_value,
  date_diff('day', ts, TIMESTAMP '2024-01-31 00:00:00') AS days_stale FROM events
WHERE date_diff('day', ts, TIMESTAMP '2024-01-31 00:00:00') > 20""")
def chk12_fresh(t):
    return row_checks.stale_rows(t["events"], "ts", "event_id", 20, d.AS_OF).withColumn(
        "days_stale", F.col("days_stale").cast("bigint"))


@workload("m12_staleness", """SELECT date_diff('minute', MAX(ts), TIMESTAMP '2024-01-31 00:00:00') AS staleness_minutes
FROM events""")
def m12_staleness(t):
    return metrics.staleness_minutes(t["events"], "ts", d.AS_OF)


INCOMPLETE = "flag IS NULL AND (l_discount IS NULL OR l_discount = 0)"


@workload("chk13_incomplete", f"WITH {LINES} SELECT line_id AS record_id FROM lines WHERE {INCOMPLETE}")
def chk13_incomplete(t):
    return row_checks.rule_violations(lines(t), INCOMPLETE, "line_id")


@workload("m13_completeness", f"""WITH {LINES}
SELECT ROUND(AVG(CASE WHEN flag IS NOT NULL THEN 100.0 ELSE 0.0 END), 2) AS completeness_pct FROM lines""")
def m13_completeness(t):
    return metrics.completeness(lines(t), "flag")


# Purchases per user and day, from all events: days without a purchase have no volume.
@workload("chk14_volume", """WITH daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, COUNT(*) FILTER (event_type = 'purchase') AS volume
  FROM events GROUP BY user_id, CAST(ts AS DATE))
SELECT user_id AS record_id, volume AS failed_value FROM daily WHERE volume = 0 AND day IS NOT NULL""")
def chk14_volume(t):
    daily = t["events"].groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("volume"))
    return row_checks.zero_volumes(daily, "volume", "day", "user_id")


@workload("m14_count", "SELECT COUNT(*) AS current_count FROM lineitem")
def m14_count(t):
    return metrics.row_count(t["lineitem"])


@workload("chk20_negative", """SELECT c_custkey AS record_id, c_acctbal AS failed_value FROM customer
WHERE c_acctbal < 0""")
def chk20_negative(t):
    return row_checks.negatives(t["customer"], "c_acctbal", "c_custkey")


@workload("chk21_total", """SELECT l_orderkey AS record_id, l_extendedprice AS failed_value,
  l_quantity * p_retailprice AS expected_total
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_quantity IS NOT NULL AND p_retailprice IS NOT NULL
  AND ABS(l_extendedprice - l_quantity * p_retailprice) > 20000""")
def chk21_total(t):
    joined = t["lineitem"].join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    return row_checks.total_mismatches(joined, "l_quantity", "p_retailprice", "l_extendedprice", 20000, "l_orderkey")


@workload("chk24_audit", f"""WITH {LINES}
SELECT line_id AS record_id FROM lines WHERE flag IS NULL OR l_shipdate < TIMESTAMP '1996-01-01 00:00:00'""")
def chk24_audit(t):
    return row_checks.rule_violations(
        lines(t), "flag IS NULL OR l_shipdate < TIMESTAMP_NTZ'1996-01-01 00:00:00'", "line_id")


@workload("m24_audit", """SELECT l_orderkey, l_linenumber, o_orderdate, l_shipdate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate IS NULL OR l_shipdate IS NULL OR l_shipdate < o_orderdate""")
def m24_audit(t):
    joined = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
    return metrics.audit_gaps(joined, "o_orderdate", "l_shipdate").select(
        "l_orderkey", "l_linenumber", "o_orderdate", "l_shipdate")


@workload("chk25_cdc_op", f"""WITH {d.CHANGE_LOG}
SELECT event_id AS record_id, op AS failed_value FROM change_log WHERE op NOT IN ('I','U','D') AND op IS NOT NULL""")
def chk25_cdc_op(t):
    return row_checks.unknown_operations(d.change_log(t), "op", "event_id", ["I", "U", "D"])


@workload("m25_cdc", f"""WITH {d.CHANGE_LOG}
SELECT op, COUNT(*) AS cnt FROM change_log WHERE op NOT IN ('I','U','D') GROUP BY op""")
def m25_cdc(t):
    return metrics.operation_violations(d.change_log(t), "op", ["I", "U", "D"])


@workload("udf_score", """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_partkey + l_suppkey = 0 THEN 100.0 ELSE CAST((2 * points + attempts) // (2 * attempts) AS DOUBLE) / 100 END AS score
FROM (SELECT *, l_partkey + l_suppkey AS attempts, l_partkey * CAST(l_quantity AS BIGINT) * 100 *
    CASE l_linenumber WHEN 1 THEN 50 WHEN 2 THEN 70 WHEN 3 THEN 85 WHEN 4 THEN 95 ELSE 80 END AS points
  FROM lineitem) s""")
def udf_score(t):
    severity = F.expr("CASE l_linenumber WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' "
                      "WHEN 4 THEN 'LOW' ELSE 'NONE' END")
    score = scoring.score_check(
        F.col("l_partkey"), F.col("l_suppkey"), severity, F.col("l_quantity").cast("decimal(5,2)"))
    return t["lineitem"].select("l_orderkey", "l_linenumber", score.cast("double").alias("score"))


@workload("udf_outlier", """SELECT event_id, COALESCE(ABS(value - 10) / NULLIF(user_id % 7, 0) > 3, FALSE) AS outlier
FROM events""")
def udf_outlier(t):
    verdict = scoring.is_outlier(F.col("value"), F.lit(10.0), F.expr("CAST(user_id % 7 AS DOUBLE)"), 3)
    return t["events"].select("event_id", verdict.alias("outlier"))


@workload("udf_regex", f"""WITH {LINES}
SELECT line_id, l_partkey, COALESCE(regexp_full_match(flag, '[AN]'), FALSE) AS valid FROM lines""")
def udf_regex(t):
    return lines(t).select("line_id", "l_partkey", scoring.matches_pattern(F.col("flag"), "[AN]").alias("valid"))


@workload("src_json_params", """SELECT event_id, event_type, json_extract_string(props, '$.k') AS k,
  CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS doubled FROM events""")
def src_json_params(t):
    from plumbline.config.specs import parse_params

    parsed = parse_params(t["events"], "props")
    k = F.col("params")["k"]
    return parsed.select("event_id", "event_type", k.alias("k"), (k.cast("bigint") * 2).alias("doubled"))
