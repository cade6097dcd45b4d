import pytest

import __spark_entry__ as entry
from plumbline.llm import host_quality as H
from tests import duck


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op8_host_quality"
    rows = duck.spark_rows(entry.queries()[name](spark, sf_dir))
    assert rows == duck.sql_rows(duck.connect(sf_dir), entry.oracle_sql()[name])


CLEAN = " ".join(f"word{k}" for k in range(80))
MENU = "home | about | " * 15 + CLEAN


def test_odd_rows(spark):
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\n ", None), (4, "x\nx\n\nx\n y", "a"), (5, "a b c a b c d", "a"), (5, "a b c a b c d", "a"),
        (6, "é" * 9 + " #*$", None), (7, CLEAN, "a"), (None, CLEAN, "b"), (8, "a b a b a b", "b"), (9, "z" * 200_000, "b"),
        (10, "\n".join([CLEAN] * 500), "b"),
    ]
    docs = spark.createDataFrame([(i, t, s, 0, 0) for i, t, s in rows], "doc_id long, text string, source string, host int, short int")
    found = H.judged(docs, carry=["host"]).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in found)
    size = len(CLEAN.replace(" ", ""))
    assert got == sorted([
        (1, 0, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0), (4, 4, 4, 0, 4, 2, 0),
        (5, 7, 7, 0, 1, 0, 6), (5, 7, 7, 0, 1, 0, 6), (6, 2, 12, 3, 1, 0, 0), (7, 80, size, 0, 1, 0, 0),
        (-1, 80, size, 0, 1, 0, 0), (8, 6, 6, 0, 1, 0, 6), (9, 1, 200_000, 0, 1, 0, 0),
        (10, 40_000, 500 * size, 0, 500, 499, 40_000)])
    assert {r.doc_id for r in found if r.kept} == {7, None}
    assert H.judged(docs.limit(0)).count() == 0


def test_host_verdict(spark):
    """Documents of a host that mostly fails go if they fail any rule; clean ones stay."""
    rows = [(k, MENU if k < 90 else CLEAN, "bad") for k in range(100)]
    rows += [(100 + k, MENU if k < 5 else CLEAN, "good") for k in range(100)]
    rows += [(200 + k, CLEAN, f"small{k}") for k in range(20)] + [(300, MENU, "tiny"), (301, MENU, None)]
    found = {r.doc_id: r for r in H.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {i for i, r in found.items() if not r.kept} == set(range(90))
    assert all(found[i].host_rejected for i in range(100)) and not found[300].host_rejected


def test_rates_are_drawn_to_the_mean(spark):
    rows = [(k, MENU if k % 4 == 0 else CLEAN, f"h{k % 10}") for k in range(400)] + [(999, MENU, "single")]
    rates = {r.host: r for r in H.host_rates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert rates["single"].symbols < 1 and rates["single"].documents == 1
    assert 0 <= rates["h1"].symbols < rates["h0"].symbols <= 0.6
    assert rates["h0"].short == pytest.approx(0)
