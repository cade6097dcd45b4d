import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import simhash_trie as S
from plumbline.llm.components import components
from plumbline.llm.spark import may_be_among, presence


def brute_fingerprint(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, budget=3):
    """(id, fingerprint) -> smallest reachable id."""
    out = {}
    rows = list(rows)
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            x = todo.pop()
            for y in range(len(rows)):
                if y not in seen and (rows[x][1] ^ rows[y][1]).bit_count() <= budget:
                    seen.add(y)
                    todo.append(y)
        ids = [rows[y][0] for y in seen if rows[y][0] is not None]
        out[k] = min(ids) if ids else None
    return out


@given(st.text(alphabet="aBcÉ \t\n\x0b ", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == brute_fingerprint(text)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 4))
def test_trie_pairs_are_all_pairs(seed, budget):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 4, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 3)).astype(np.uint64)
    values = np.unique(base[rng.integers(0, 4, 60)] ^ np.bitwise_xor.reduce(flips, axis=1))
    found = set()
    for i, j in S.trie_pairs(values, np.array([[0, len(values), 0, len(values)]]), budget, at_once=16):
        found |= set(zip(i.tolist(), j.tolist()))
    n = len(values)
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n) if int(values[i] ^ values[j]).bit_count() <= budget}


def near_set(seed, n=120):
    rng = random.Random(seed)
    out = set()
    centre = rng.getrandbits(63)
    while len(out) < n:
        x = centre if rng.random() < 0.7 else rng.getrandbits(63)
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randint(0, 62)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("share", [8, 8192])
def test_links_connect_as_all_pairs_do(spark, share):
    """With small shares, large buckets are split and joined share by share."""
    values = near_set(5)
    links = S.fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long"), 3, share)
    roots = {r.node: r.root for r in components(links).collect()}
    expected = brute_components([(v, v) for v in values])
    got = {}
    for v in values:
        got.setdefault(roots.get(v, v), []).append(v)
    named = {v: min(group) for group in got.values() for v in group}
    assert named == {values[k]: c for k, c in expected.items()}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    chain = list(range(400))
    rng.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, 1000 + k) for k in range(1, 50)] + [(2000, 2000), (3001, 3000)] * 2
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({found[x] for x in chain}) == 1 and len({found[1000 + k] for k in range(50)}) == 1
    assert found[3000] == found[3001] and 2000 not in found and len(set(found.values())) == 3
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = [
    (7, "the quick brown fox jumps over the lazy dog " * 30), (3, "The Quick brown fox jumps over the lazy dog " * 30),
    (9, None), (4, ""), (5, " \n\t"), (8, "word"), (6, "word"), (6, "word"), (None, "word"), (10, "é" * 9),
    (11, "other words entirely " * 4000), (None, "nobody else says this at all"),
]


def test_rows_that_are_odd(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, fp string, component_id int")
    rows = S.similar(docs).collect()
    got = sorted((r.doc_id or -1, r.fp & (2**64 - 1), r.component_id or -1) for r in rows)
    prints = [(i, brute_fingerprint(t)) for i, t in TEXTS]
    expected = brute_components(prints)
    assert got == sorted((i or -1, f, expected[k] or -1) for k, (i, f) in enumerate(prints))
    assert S.similar(docs.limit(0)).count() == 0


def test_near_copies(spark):
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(3000)]
    rows, groups = [], {}
    for k in range(40):
        base = rng.choices(words, k=rng.randint(60, 300))
        for c in range(3):
            changed = list(base)
            for at in rng.sample(range(len(base)), len(base) // 80 if c else 0):
                changed[at] = rng.choice(words)
            rows.append((len(rows), " ".join(changed)))
            groups[rows[-1][0]] = k * 3
    rows += [(500, None), (501, ""), (502, "one"), (503, "one"), (504, "two"), (None, rows[0][1])]
    found = S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    named = {r.doc_id: r.component_id for r in found}
    assert {i: named[i] for i in groups} == groups
    assert named[501] == 500 and named[503] == 502 and named[504] == 504 and named[None] == 0 and len(found) == len(rows)
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("total, shared, alike", [
    (178, 156, False), (180, 160, True), (182, 164, True), (185, 170, True)])
def test_near_copies_are_decided_by_their_sets(spark, total, shared, alike):
    """Pairs of a similarity of exactly 0.78, 0.80, 0.82 and 0.85."""
    rows = []
    for k in range(60):
        common = [f"w{k}x{n}" for n in range(shared + 4)]
        for side in "ab":
            rows.append((len(rows), " ".join(common + [f"{side}{k}x{n}" for n in range(total - shared)])))
    found = S.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {i: i - i % 2 if alike else i for i, _ in rows}


def test_groups_cut_by_batches(spark):
    """Groups that end within, or span, several Arrow batches are joined whole."""
    values = near_set(9, 300)
    table = spark.createDataFrame([(v,) for v in values], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        a = {(r.a, r.b) for r in S.fingerprint_links(table, 3, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert a and all((x ^ y).bit_count() >= 1 for x, y in a)


def test_forest():
    forest = S.Forest(6)
    forest.join(np.array([5, 3, 1]), np.array([4, 5, 2]))
    a, b = forest.links()
    assert sorted(zip(a.tolist(), b.tolist())) == [(1, 2), (3, 4), (3, 5)]
    assert isinstance(S.join_groups(pa.table({c: pa.array([0, 0], pa.int64()) for c in (
        "key", "i", "j", "side", "node", "value")}), 3, 64, None), pa.RecordBatch)


def jaccard_components(sets, similarity=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return dict(enumerate(root))


def test_one_template_just_below_and_around_the_limit(spark):
    """500 texts of one template with own words at 0.76 of each other, and 120 edits of one text between 0.5 and 1."""
    rng = random.Random(3)
    template = [f"w{k}" for k in range(120)]
    texts = [template + [f"own{t}x{k}" for k in range(18)] for t in range(500)]
    edits = [[f"v{k}" for k in range(150)]]
    while len(edits) < 120:
        changed = list(rng.choice(edits))
        for at in rng.sample(range(150), rng.randrange(1, 6)):
            changed[at] = f"u{rng.randrange(40)}"
        edits.append(changed)
    texts += edits
    rng.shuffle(texts)
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    expected = jaccard_components(sets)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    found = {r.doc_id: r.component_id for r in S.near_copies(df).collect()}
    assert found == expected and len(set(expected.values())) > 500


def test_sets_that_meet_in_shares(spark):
    """Members of groups in many shares are linked as all pairs would link them."""
    rng = random.Random(8)
    sets = [sorted(rng.sample(range(40), rng.randrange(8, 14))) for _ in range(60)]
    sets += [sorted({*s, 40 + k} - {s[0]}) for k, s in enumerate(sets[:30])] + [[]]
    rows = [(7, i, 0, np.array(s, np.uint32).tobytes()) for i, s in enumerate(sets)]
    rows += [(8, 1000 + i, 0, np.array(s, np.uint32).tobytes()) for i, s in enumerate(sets[:3])]
    members = spark.createDataFrame(rows, "key long, node long, value long, whole binary")
    expected = jaccard_components([set(s) if s else {-1} for s in sets], 0.5)
    for share in (2048, 5):
        links = [(r.a, r.b) for r in S.bucket_links(members, lambda t: S.join_sets(t, 0.5), share).collect()]
        assert len(links) <= len(rows) * (1 if share > 100 else len(rows) // share + 2)
        root = list(range(len(sets)))
        for a, b in links:
            if a >= 1000:
                assert b >= 1000
                continue
            assert len({*sets[a]} & {*sets[b]}) >= 0.5 * len({*sets[a]} | {*sets[b]})
            old, new = max(root[a], root[b]), min(root[a], root[b])
            root = [new if r == old else r for r in root]
        assert dict(enumerate(root)) == expected


def test_rows_without_a_partner_are_left_out_before_they_are_shuffled(spark):
    rng = np.random.default_rng(8)
    names = rng.integers(-2**63, 2**63, 4000)
    names[:3] = -1, 0, 2**63 - 1
    held = spark.createDataFrame([(int(x),) for x in names[:2000]], "node long")
    words = presence(held, F.col("node"))
    assert may_be_among(words, names[:2000]).all()
    assert may_be_among(words, names[2000:]).sum() < 10
    texts = [f"some words of text number {k} and others" for k in range(300)]
    sets = S.shingle_sets(spark.createDataFrame([(t,) for t in texts], "text string"), 5, np.full(1 << 19, -1))
    wanted = sorted(r.node for r in sets.collect())[::50]
    words = presence(spark.createDataFrame([(x,) for x in wanted], "node long"), F.col("node"))
    found = S.shingle_sets(spark.createDataFrame([(t,) for t in texts], "text string"), 5, words).collect()
    assert sorted(r.node for r in found) == wanted
