"""The whole pipeline, and every stage of it on its own input, against brute force."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as C
from plumbline.session import cut_lineage
from tests.llm.test_suffix_family import brute as brute_repeats

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopéü", k=rng.randint(3, 9))) for _ in range(8000)]
    words = lambda n: rng.choices(vocabulary, k=n)
    items = [" ".join(words(25)) for _ in range(6)]
    texts = [words(rng.randint(70, 250)) for _ in range(60)]
    passage = words(30)
    for k in (3, 8, 15):
        texts[k][20:20] = passage
    for k, item in zip((5, 9, 20), items):
        texts[k][30:30] = item.split()
    for k in (1, 12, 33):
        texts.append(list(texts[k]))
    for k in (2, 8, 40):
        changed = list(texts[k])
        changed[len(changed) // 2] = "changed"
        texts.append(changed)
    texts += [words(10), ["so", "it", "goes"] * 40, [], words(60) * 3]
    rows = [(100 + k, " ".join(t)) for k, t in enumerate(texts)] + [(90, None), (91, "\n \t"), (92, "x" * 5000), (110, " ".join(texts[10]))]
    rng.shuffle(rows)
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in rows], items


ROWS, ITEMS = corpus()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def after_rules(rows):
    out = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        seen, hit = {}, set()
        for k in range(len(w) - 2):
            seen.setdefault(tuple(w[k:k + 3]), []).append(k)
        for places in seen.values():
            if len(places) > 1:
                hit |= {k + d for k in places for d in range(3)}
        if not (len(w) < 50 or 100 * len(hit) > 50 * len(w)):
            out.append(r)
    return out


def shingles(text):
    w = text.lower().split()
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def after_near_copies(rows):
    rows = sorted({r[0]: r for r in rows}.values())
    kept, groups = [], []
    for r in rows:
        s = shingles(r[1])
        near = [g for g in groups if any(len(s & o) >= 0.8 * len(s | o) for o in g)]
        if near:
            near[0].append(s)
        else:
            groups.append([s])
            kept.append(r)
    return kept


def after_passages(rows):
    out = []
    by = {r[0]: r for r in rows}
    for i, _, removed, _, kept in brute_repeats([(r[0], r[1]) for r in rows]):
        text = kept.decode("utf-8", "ignore")
        if not removed or text.split():
            out.append((i, text, by[i][2], by[i][3], len(text)))
    return out


def after_benchmark(rows):
    plain = lambda t: f" {' '.join(re.findall(r'[^\W_]+', t.lower()))} "
    return [r for r in rows if not any(plain(t) in plain(r[1]) for t in ITEMS)]


def check_packed(found, rows):
    expected = []
    for i, text, *_ in rows:
        ids = TOKENIZER.encode(text, add_special_tokens=False).ids + [0]
        expected += [(i, k, at, len(ids[at:at + 2048]), zlib.crc32(np.array(ids[at:at + 2048], "<u4").tobytes()))
                     for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted(tuple(r[:5]) for r in found) == sorted(expected)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048


BRUTE = [after_rules, after_near_copies, after_passages, after_benchmark]


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    expected = ROWS
    for (name, stage), brute in zip(C.STAGES, BRUTE):
        docs = cut_lineage(stage(spark, docs, tables), name)
        assert docs.columns == list(C.COLUMNS) and docs.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
        before, expected = expected, brute(expected)
        key = lambda r: (r[0], r[1])
        assert sorted((tuple(r) for r in docs.collect()), key=key) == sorted(expected, key=key), name
        assert 0 < len(expected) <= len(before)
    name, stage = C.STAGES[4]
    check_packed(stage(spark, docs, tables).collect(), expected)
    check_packed(C.run(spark, tables).collect(), expected)


def test_registered(spark, sf_dir):
    assert len(C.STAGES) == 5 and "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    found = entry.queries()["pipeline"](spark, sf_dir).collect()
    ids = {r.doc_id for r in found}
    kept = {r.doc_id for r in entry.queries()["op8_host_quality"](spark, sf_dir).where("kept").collect()}
    assert ids and ids <= kept
    copies = {r.doc_id for r in entry.queries()["op1_simhash_trie"](spark, sf_dir).where("doc_id <> component_id").collect()}
    leaked = {r.doc_id for r in entry.queries()["op6_spaced_seeds"](spark, sf_dir).collect()}
    assert len(kept - ids) >= len(kept & copies) // 2
    assert len(ids & leaked) < len(leaked)


def test_empty_tables_and_nulls(spark, tables, tmp_path):
    empty = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert C.run(spark, empty).count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "a b", None, None, 3), (1, None, "x", None, None),
                                 (1, None, "x", None, None)], SCHEMA)
    for _, stage in C.STAGES:
        assert stage(spark, odd, tables).count() >= 0
        assert stage(spark, odd.limit(0), tables).count() == 0


def test_only_texts_that_may_go_are_joined(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in [None, 5, 5, *range(2000)]], "doc_id long, text string").write.parquet(
        str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    gone = spark.createDataFrame([(i,) for i in range(0, 2000, 40)], "doc_id long")
    left = C.without(docs, gone)
    key = lambda r: (r.doc_id or -1, r.text)
    assert sorted(left.collect(), key=key) == sorted(docs.join(gone, "doc_id", "left_anti").collect(), key=key)
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftAnti") == 1 and plan.count("ArrowEvalPython") + plan.count("ArrowUDF") >= 2
