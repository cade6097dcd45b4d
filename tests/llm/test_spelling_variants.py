import random
import re
import zlib
from collections import Counter

import numpy as np

import __spark_entry__ as entry
from plumbline.llm import spelling_variants as V
from tests import duck

LOWER = {c: c + 32 for c in range(65, 91)}


def test_query_agrees_with_sql(spark, sf_dir):
    name = "op11_spelling_variants"
    rows = duck.spark_rows(entry.queries()[name](spark, sf_dir))
    assert rows == duck.sql_rows(duck.connect(sf_dir), entry.oracle_sql()[name])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def brute_words(rows, every=97):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def brute(words):
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) < 2 and distance(w, v) == 1] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


def found(words_df, **options):
    rows = V.variants(words_df, **options).collect()
    return sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows)


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_words_like_brute_force(spark):
    rng = random.Random(5)
    letters = "abÀéÿ×ß"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)) for _ in range(40)]
    rows = list(enumerate(texts * 4)) + [
        (None, "hello hello hello WORLD WÖRLD"), (1, None), (2, ""), (3, "12 .. Āā"), (4, "x" * 100_000), (4, "x" * 100_000),
        (5, "x" * 100_000), (-3, "Straße STRAßE straße STRASSE İstanbul"), (7, "ÀÉÎÕÜ àéîõü ÀÉÎÕÜ ÀÉÎÕÜ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS word", "1 AS n", "2 AS h", "'r' AS run")
    for every in (97, 3):
        words = {r.word: r.n for r in V.word_counts(docs, every=every).collect()}
        assert words == brute_words(rows, every)
    assert V.variants(V.word_counts(docs.limit(0))).count() == 0


def test_variants_like_brute_force(spark):
    rng = random.Random(9)
    words = {}
    for letters, sizes, count in (("ab", (5, 9), 250), ("abé", (5, 7), 200), ("qrstuvwxyz", (5, 6), 200), ("a", (5, 40), 40)):
        for _ in range(count):
            words["".join(rng.choice(letters) for _ in range(rng.randrange(*sizes)))] = rng.choice([3, 3, 4, 6, 8, 12, 24, 100])
    for word in list(words)[:200]:
        at, c = rng.randrange(len(word)), rng.choice("abcxé")
        for other in (word[:at] + c + word[at:], word[:at] + word[at + 1:], word[:at] + c + word[at + 1:]):
            if len(other) >= 5:
                words.setdefault(other, rng.choice([3, 7, 50]))
    expected = brute(words)
    assert sum(r[2] for r in expected) > 2000 and max(r[2] for r in expected) > 10
    assert found(frame(spark, words)) == expected
    assert found(frame(spark, words), share=7) == expected


def test_chain_of_forms(spark):
    chain = {"a" * k: 3 * 2 ** k for k in range(5, 37)}
    rows = found(frame(spark, chain))
    assert rows == brute(chain) and {r[5] for r in rows} == {"a" * 36}


def test_one_group_holds_many_words(spark):
    """Words that share their first half, in shares, and the other half in groups of its own."""
    words = {f"common{a}{b}{c}{d}": 3 + (a + b) for a in range(10) for b in range(10) for c in range(5) for d in range(3)}
    words = {w.translate({48 + k: 97 + k for k in range(10)}): n for w, n in words.items()}
    assert found(frame(spark, words), share=100) == brute(words)


def test_scan_reuses_and_skips(spark):
    """Rows are computed once for a shared prefix, and not at all behind a prefix that is too far."""
    words = sorted(["aaaaab", "aaaaac", "aaazzz", "aaazzzy", "aaazzx"])
    width = 7
    codes, queries = V.code_points(words, width), V.code_points(["aaaaaa"], 6)
    near = {words[k] for k, _ in V.near_in_list(codes, np.array([len(w) for w in words]), queries, 3)}
    assert near == {"aaaaab", "aaaaac"}
