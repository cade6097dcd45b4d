import random
from collections import defaultdict

import __spark_entry__ as entry
from plumbline.llm import line_dedup as L
from tests import duck

SPACE = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op12_line_dedup"
    rows = duck.spark_rows(entry.queries()[name](spark, sf_dir))
    assert rows == duck.sql_rows(duck.connect(sf_dir), entry.oracle_sql()[name])


def brute(rows, min_chars=40, min_documents=5):
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[line.strip(SPACE).translate(LOWER)].add(i)
    out = []
    for i, t in rows:
        kept, lines = [], (t or "").split("\n")
        for line in lines:
            key = line.strip(SPACE).translate(LOWER)
            ids = held[key] - {None}
            if len(key) < min_chars or len(ids) < min_documents or (i is not None and i == max(ids)):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in L.without_common_lines(df, **options).collect()), key=repr)


def test_odd_rows(spark):
    shared, capital = "shared line " * 4 + "é", "SHARED LINE " * 4 + "é"
    exact, short = "x" * 40, "x" * 39
    umlaut = "ä" * 39
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, shared + "\nown\n" + capital), (5, f"  {shared}\r\n\nend"), (6, f"\t{capital}"),
        (7, shared), (7, shared), (7, "other\n" + shared), (8, shared.upper()), (9, shared), (None, shared + "\nkept"),
        (None, None), (None, shared + "\nkept"),
        *[(k, f"{exact}\n{short}\n{umlaut}\nown {k}") for k in range(20, 25)], *[(k, "y" * 50) for k in range(30, 34)], (30, "y" * 50),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr(
        "*", "1 AS h1", "2 AS h2", "'a' AS lines", "'b' AS gone", "3 AS position")
    assert found(docs) == brute(rows)
    assert found(docs.limit(0)) == []
    by_name = docs.withColumnRenamed("doc_id", "name").withColumnRenamed("text", "body")
    assert found(by_name, id_column="name", text="body", min_chars=39, min_documents=2) == brute(rows, 39, 2)


def test_very_long_text_and_hot_line(spark):
    hot = "a passage that stands in every document of this test"
    rows = [(k, f"{hot}\n{'z' * (k % 50)}") for k in range(2000)]
    rows += [(5000, "\n".join([hot, "own"] * 100_000)), (5001, hot)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)) == brute(rows)


def test_random_texts(spark):
    rng = random.Random(3)
    parts = [rng.choice("abcAB é") * rng.randrange(1, 6) for _ in range(12)]
    rows = [(rng.randrange(30), "\n".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(docs, min_chars=3, min_documents=3) == brute(rows, 3, 3)


def test_plan_stays_in_the_jvm(spark, sf_dir):
    plan = entry.queries()["op12_line_dedup"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "Cartesian" not in plan
