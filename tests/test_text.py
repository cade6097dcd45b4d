"""Guards on adversarial replies."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.plans.dashboards import run_query


def one(spark, function, value, *args, **kwargs):
    df = spark.createDataFrame([(value,)], "r string")
    return df.select(function(F.col("r"), *args, **kwargs).alias("v")).first().v


@pytest.mark.parametrize("reply,loose,strict", [
    ("SAFE_TO_AUTOMATE: yes", "SAFE_TO_AUTOMATE", "SAFE_TO_AUTOMATE"),
    ("safe_to_automate", "SAFE_TO_AUTOMATE", "SAFE_TO_AUTOMATE"),
    ("UNSAFE_TO_AUTOMATE", "SAFE_TO_AUTOMATE", "REQUIRES_HUMAN_REVIEW"),
    ("NOT SAFE_TO_AUTOMATE", "SAFE_TO_AUTOMATE", "REQUIRES_HUMAN_REVIEW"),
    ("REQUIRES_HUMAN_REVIEW, not SAFE", "REQUIRES_HUMAN_REVIEW", "REQUIRES_HUMAN_REVIEW"),
    ("REQUIRES_HUMAN_REVIEW or SAFE_TO_AUTOMATE", "SAFE_TO_AUTOMATE", "REQUIRES_HUMAN_REVIEW"),
    ("this is unsafe", "UNSAFE", "UNSAFE"), ("no idea", "UNKNOWN", "UNKNOWN"), ("", "UNKNOWN", "UNKNOWN"),
])
def test_safety(spark, reply, loose, strict):
    assert one(spark, text.classify_safety, reply, whole_words=False) == loose
    assert one(spark, text.classify_safety, reply) == strict


def test_like_form_takes_underscore_for_any_character(spark):
    assert one(spark, text.classify_safety_like, "SAFE TO AUTOMATE") == "SAFE_TO_AUTOMATE"
    assert one(spark, text.classify_safety, "SAFE TO AUTOMATE") == "UNKNOWN"


@pytest.mark.parametrize("reply,sql", [
    ("x\n```sql\n UPDATE t SET a = 1;\n```\ny", "UPDATE t SET a = 1;"),
    ("```sql\nUPDATE t\nSET a = 1\n```\n```sql\nUPDATE u\n```", "UPDATE t\nSET a = 1"),
    ("```SQL\nUPDATE t SET a = 1\n```", "UPDATE t SET a = 1"),
    ("```sql\n\n```\nupdate t set a = 1", "update t set a = 1"),
    ("```sql\nUPDATE t SET a = 1", "UPDATE t SET a = 1"),
    ("text\n  insert into t\n  values (1)\n\nrest", "insert into t values (1)"),
    ("merge into t\r\nusing u\r\n```\nrest", "merge into t using u"),
    ("UPDATE t", None), ("updates happen here", None), ("SELECT 1 FROM t", None), ("", None), (None, None),
])
def test_extract_statement(spark, reply, sql):
    assert one(spark, text.extract_statement, reply) == sql


@pytest.mark.parametrize("reply,sql", [
    ("```sql\nSELECT a FROM t;\n```", "SELECT a FROM t"), ("so\nselect a\nfrom t\n```", "select a from t"),
    ("WITH x AS (SELECT 1) SELECT 2", None), ("selected items are here", "selected items are here"),
])
def test_extract_query(spark, reply, sql):
    assert one(spark, text.extract_query, reply) == sql


@pytest.mark.parametrize("sql,status,message", [
    ("UPDATE t SET a = 1", "ACCEPTED", None), (" merge into t", "ACCEPTED", None),
    ("UPDATE t SET a = 'drop table'", "BLOCKED", "blocked keyword: DROP"),
    ("delete from t", "BLOCKED", "blocked keyword: DELETE FROM"),
    ("CREATE x; DROP y", "BLOCKED", "blocked keyword: DROP"),
    ("DELETE t", "BLOCKED", "not UPDATE, INSERT or MERGE"), ("UPDATED t", "BLOCKED", "not UPDATE, INSERT or MERGE"),
    (None, "ERROR", "no statement found"),
])
def test_guard_statement(spark, sql, status, message):
    assert tuple(one(spark, text.guard_statement, sql)) == (status, message)


@pytest.mark.parametrize("sql,status,message", [
    ("SELECT 1 FROM dq.x.v_check_summary", "ACCEPTED", None),
    ("select * from V_OVERALL_HEALTH join DQ_RUN_LOG", "ACCEPTED", None),
    ("SELECT ';' FROM v_check_summary", "ACCEPTED", None),
    ("SELECT 'a FROM v_check_summary; x", "ACCEPTED", None),
    ("SELECT 1 FROM v_check_summary; SELECT 2", "BLOCKED", "several statements"),
    ("SELECT 1 FROM orders", "BLOCKED", "unapproved object: orders"),
    ("SELECT 1 FROM v_check_summary JOIN a.b.Orders o", "BLOCKED", "unapproved object: a.b.Orders"),
    ("WITH x AS (SELECT 1 FROM v_check_summary) SELECT * FROM x", "BLOCKED", "unapproved object: x"),
    ("SELECT update FROM v_check_summary", "BLOCKED", "blocked keyword: UPDATE"),
    ("EXPLAIN SELECT 1", "BLOCKED", "not SELECT or WITH"), (None, "ERROR", "no query found"),
])
def test_guard_query(spark, sql, status, message):
    assert tuple(one(spark, text.guard_query, sql)) == (status, message)


def test_bounded_query(spark):
    spark.range(200).createOrReplaceTempView("v_check_summary")
    status, message, rows = run_query(spark, "SELECT id FROM v_check_summary ORDER BY id", text.READABLE_OBJECTS)
    assert (status, message, rows.count()) == ("SUCCESS", None, 50)
    assert run_query(spark, "SELECT nope FROM v_check_summary", text.READABLE_OBJECTS)[0] == "EXECUTION_ERROR"
    assert run_query(spark, "DROP TABLE x", text.READABLE_OBJECTS)[:2] == ("BLOCKED", "not SELECT or WITH")
    spark.range(3).createOrReplaceTempView("secret")
    for sql in ("SELECT * FROM `secret`", "SELECT s.id FROM v_check_summary, secret s",
                "SELECT id FROM v_check_summary WHERE id IN (SELECT id FROM v_check_summary, `secret` t)"):
        assert run_query(spark, sql, text.READABLE_OBJECTS)[:2] == ("BLOCKED", "unapproved object: secret")
    named = "WITH n AS (SELECT id FROM v_check_summary) SELECT n.id FROM v_check_summary, n WHERE n.id = 1 LIMIT 3"
    assert run_query(spark, named, text.READABLE_OBJECTS)[0] == "SUCCESS"
    late = "SELECT CAST(concat('x', id) AS INT) AS n FROM v_check_summary"
    assert run_query(spark, late, text.READABLE_OBJECTS)[0] == "EXECUTION_ERROR"


def test_long_reply_is_read_whole(spark):
    lines = "\n".join(f"line {i}" for i in range(50_000))
    statement = "UPDATE t SET a = 1,\n" + "\n".join(f"c{i} = {i}," for i in range(20_000)) + "\nz = 1"
    found = one(spark, text.extract_statement, lines + "\n" + statement + "\n\nend")
    assert found == statement.replace("\n", " ")
