"""Physical plans: what reaches the scan, and what never happens above it."""

import pytest

from plumbline.workloads import WORKLOADS


def plan(spark, sf_dir, name):
    return WORKLOADS[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,pushed,columns", [
    ("chk06_range", "Or(LessThan(p_retailprice,910.0),GreaterThan(p_retailprice,1040.0))", "p_partkey:bigint,p_retailprice:double"),
    ("chk20_negative", "LessThan(c_acctbal,0.0)", "c_custkey:bigint,c_acctbal:double"),
    ("chk10_rule", "EqualTo(l_returnflag,N)", "l_orderkey:bigint,l_quantity:double,l_discount:double,l_returnflag:string"),
    ("chk23_multisource", "EqualTo(o_orderpriority,1-URGENT)", "o_totalprice:double,o_orderdate:timestamp_ntz,o_orderpriority:string"),
    ("m09_domain", "", "l_partkey:bigint,l_returnflag:string"),
    ("chk02_pk", "", "l_orderkey:bigint"),
    ("m14_count", "", ""),
])
def test_scan_reads_what_is_needed(spark, sf_dir, name, pushed, columns):
    text = plan(spark, sf_dir, name)
    assert pushed in text
    assert f"ReadSchema: struct<{columns}>" in text


@pytest.mark.parametrize("name", ["chk02_pk", "chk03_dup", "chk19_dup_file", "m09_domain", "chk23_multisource"])
def test_groups_are_counted_before_the_shuffle(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text
