"""Every registered query against SQL over the same files, whole tables, exact values."""

import re

import pytest

import __spark_entry__ as entry_module
from plumbline.workloads import WORKLOADS
from tests import duck

QUERIES = {name: entry_module.queries()[name] for name in WORKLOADS}
ORACLES = {name: sql for name, sql in entry_module.oracle_sql().items() if name in WORKLOADS}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return duck.connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, sf_dir, connection, name):
    df = QUERIES[name](spark, sf_dir)
    assert duck.spark_rows(df) == duck.sql_rows(connection, ORACLES[name])
    check_plan(df._jdf.queryExecution().executedPlan().toString())


def check_plan(plan):
    """No join without a key, no row handed to Python, no window that gathers a table in one task."""
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert not re.search(r"EvalPython|InPandas|InArrow", plan)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if re.search(r"\bWindow \[", line):
            assert not any("SinglePartition" in below for below in lines[i + 1:i + 5])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.target_table for r in rows} == {"customer", "orders"}
    assert all(r.total_checks == 4 for r in rows)
