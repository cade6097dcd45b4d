import random
import re

import pytest

from plumbline.llm import spaced_seeds as S
from plumbline.llm.queries import QUERIES

rng = random.Random(2)
VOCABULARY = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(5000)]


def words(n):
    return rng.choices(VOCABULARY, k=n)


ITEMS = [(k, " ".join(words(rng.randint(13, 60)))) for k in range(30)]


def planted(item, replaced=0):
    inner = item.split()
    for at in rng.sample(range(len(inner)), replaced):
        inner[at] = "zzz"
    return " ".join(words(40) + inner + words(40))


def run(spark, docs, items=ITEMS):
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, item_id int, hashes string")
    found = S.contaminated(frame, spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_exact_and_replaced_words(spark):
    docs, expected = [], set()
    for k, item in ITEMS:
        docs.append((100 + k, planted(item).upper().replace(" ", ", ")))
        expected.add((100 + k, k))
        # One word in ten replaced, at any place.
        docs.append((200 + k, planted(item, max(1, len(item.split()) // 10) if len(item.split()) > 19 else 0)))
        expected.add((200 + k, k))
        docs.append((300 + k, " ".join(words(200))))
    assert set(run(spark, docs)) == expected


def test_partial_passages(spark):
    long = [(k, t) for k, t in ITEMS if len(t.split()) > 40]
    docs = [(k, " ".join(words(9) + t.split()[10:30] + words(9))) for k, t in long]
    docs += [(1000 + k, " ".join(words(9) + t.split()[10:16] + words(9))) for k, t in long]
    found = run(spark, docs)
    assert set(found) == {(k, k) for k, _ in long}
    assert all(r.score >= 20 and r.matched >= 20 for r in found.values())


def test_odd_rows(spark):
    item = ITEMS[0][1]
    items = ITEMS + [(50, None), (51, ""), (52, item + "!"), (53, "only four words here"), (54, "now these are five words"), (None, item)]
    docs = [(1, None), (2, ""), (3, item), (3, item), (4, f"{item} {item}"), (None, item), (5, "only four words here and more"),
            (6, "So now THESE are five words."), (7, " ".join(words(30_000) + item.split())), (8, item.split()[0])]
    found = run(spark, docs, items)
    assert set(found) == {(3, 0), (4, 0), (None, 0), (6, 54), (7, 0)}
    assert found[3, 0].items == 3 and found[3, 0].matched == len(item.split())
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}


def test_short_items_with_one_replaced_word(spark):
    """Items of 5 to 12 words, a word replaced at each place: accepted from 8 words on, as brute force over all places says."""
    items = [(n, " ".join(words(n))) for n in range(5, 13)]
    docs = {}
    for n, item in items:
        for at in range(n):
            inner = item.split()
            inner[at] = "zzz"
            docs[100 * n + at] = " ".join(words(20) + inner + words(20))
        docs[100 * n + 99] = " ".join(words(20) + item.split() + words(20))

    def accepted(text, item):
        best, a, b = 0, text.split(), item.split()
        for shift in range(-len(b) + 1, len(a)):
            run = 0
            for k, word in enumerate(b):
                if 0 <= shift + k < len(a):
                    run = max(0, run + (1 if a[shift + k] == word else -2))
                    best = max(best, run)
        return best >= min(10, len(b) - 3 * (len(b) // 8))

    expected = {(d, n) for d, t in docs.items() for n, item in items if accepted(t, item)}
    assert set(run(spark, list(docs.items()), items)) == expected
    assert expected == {(d, d // 100) for d in docs if d // 100 >= 8 or d % 100 == 99}


def test_without_broadcast(spark, monkeypatch):
    docs = [(k, planted(t)) for k, t in ITEMS]
    expected = set(run(spark, docs))
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert set(run(spark, docs)) == expected == {(k, k) for k, _ in ITEMS}


@pytest.mark.parametrize("name", ["op6_spaced_seeds"])
def test_query_holds_every_exact_passage(spark, sf_dir, name):
    def plain(text):
        return f" {' '.join(re.findall(r'[^\W_]+', text.lower()))} "

    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(r.doc_id, k) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
             for k, t in items.items() if t in plain(r.text)}
    df = QUERIES[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert {(r.doc_id, r.item_id) for r in df.collect()} >= exact
