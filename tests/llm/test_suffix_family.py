import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffix_family as S


def brute(rows, n=50):
    """Per row: bytes, removed bytes, removed runs, kept bytes."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        if i is not None:
            for p in range(len(b) - n + 1):
                first[b[p:p + n]] = min(i, first.get(b[p:p + n], i))
    out = []
    for i, b in texts:
        cover = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            if i is not None and first[b[p:p + n]] < i:
                cover[p:p + n] = True
        runs = int((np.diff(np.r_[0, cover.astype(int), 0]) == 1).sum())
        out.append((i, len(b), int(cover.sum()), runs, np.frombuffer(b, np.uint8)[~cover].tobytes()))
    return out


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "y") for i, t in rows], "doc_id long, text string, kept string")
    found = S.remove_repeats(df, carry=["kept"], **options) if options.pop("carry", False) else S.remove_repeats(df, **options)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()), key=key)
    assert got == sorted(brute(rows, options.get("length", 50)), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_like_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé \n", k=rng.randint(1, 9))) for _ in range(200)]
    passages = ["".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for k in range(80):
        parts = rng.choices(words, k=rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts.insert(rng.randint(0, len(parts)), p[cut:] if rng.random() < 0.5 else p)
        rows.append((k, "".join(parts)))
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("hot", [0, 5, 10**6])
def test_hot_grams(spark, hot):
    """A passage between neighbours that differ, repeat in part and stand in texts of one id."""
    rng = random.Random(4)
    passage = "this passage stands in very many of the documents"
    rows = []
    for k in range(120):
        left, right = ("".join(rng.choices("abc ", k=rng.randint(0, 40))) for _ in range(2))
        rows.append((k - k % 7 // 6, left + passage * rng.randint(1, 2) + right))
        if k % 5 == 0:
            rows.append((k + 300, rng.choice(rows)[1][rng.randint(0, 9):] + rng.choice("xy") * 60))
    rows += [(None, passage * 3), (-1, "z" * 30 + passage), (999, "é" * 300 + rows[8][1])]
    check(spark, rows, hot=hot)


def test_spans_of_a_hot_gram_spread_over_buckets():
    rng = random.Random(2)
    texts = [("".join(rng.choices("abcd", k=40)) + "one passage of at least fifty bytes, in all of the texts" + "".join(
        rng.choices("abcd", k=40))).encode() for _ in range(400)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts])
    starts = np.cumsum(size) - size
    n = len(texts)
    packer = S.SpanPacker(16)
    same, ids = np.full(n, 12345, np.uint64), np.arange(n)
    batches = list(packer.add(data, starts, size, same, ids, ids.astype(np.uint64), np.zeros(n, np.int64), np.ones(n, bool)))
    batches += list(packer.flush())
    held, covered = np.zeros(16, np.int64), {}
    for b in range(16):
        rows = [r for batch in batches for name, r in zip(*[c.to_pylist() for c in batch.columns]) if name == b]
        fixed, spans = S.unpack_spans(rows)
        held[b] = len(spans)
        for d, _, lo, hi in zip(*S.covered_ranges(fixed, spans, 50)):
            covered.setdefault(int(d), set()).update(range(lo, hi))
    assert held.max() < 2 * held.sum() / 16
    expected = brute([(i, t.decode()) for i, t in enumerate(texts)])
    assert [len(covered.get(i, ())) for i in range(n)] == [r[2] for r in expected]


def test_odd_rows(spark):
    line = "a line of some fifty and more bytes that many documents share, word by word.\n"
    rows = [
        (1, None), (2, ""), (3, "short"), (4, "a" * 49), (5, "a" * 50), (6, "a" * 51), (7, "a" * 5000), (8, "a" * 49 + "b"),
        (9, line), (10, line), (10, line), (10, line + "x"), (11, "é" * 40), (12, "xé" + "é" * 40), (None, line), (None, line),
        (13, line * 3 + "b"), (14, "z" + line[:60]), (15, line[:-1] + "\x00" * 60), (16, "\x00" * 60), (-5, line[5:]),
        (17, "q" * 200_000 + line), (18, "q" * 200_000),
    ]
    check(spark, rows)
    check(spark, [])
    check(spark, rows[::-1])


def test_other_lengths(spark):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choices("ab", k=rng.randint(0, 60)))) for k in range(40)]
    check(spark, rows, length=12, gram=5)


def test_family_levels_grow_geometrically():
    rng = np.random.default_rng(1)
    family, seen, docs = S.SuffixFamily(3), {}, 0
    for batch in range(40):
        raw = rng.integers(97, 105, (50, 3), dtype=np.uint8)
        windows = np.ascontiguousarray(raw).view("S3").ravel()
        owners = np.sort(rng.integers(docs, docs + 5, 50))
        docs += 5
        first = family.add(windows, owners)
        for w, d in zip(windows, owners):
            seen[w] = min(d, seen.get(w, d))
        assert [seen[w] for w in windows] == first.tolist()
        sizes = [len(level[0]) for level in family.levels]
        assert all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert sum(len(level[0]) for level in family.levels) == len(seen)


def test_whole_characters(spark):
    shared = "é" * 30
    rows = [(1, shared), (2, "x" + shared[:25] + "yé"), (3, "a" + shared + "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut = {r.doc_id: bytes(r.kept).decode() for r in S.remove_repeats(df, whole_characters=True).collect()}
    assert cut[1] == shared and cut[3] == "ab"


def test_hashes_of_grams():
    data = np.frombuffer(b"abcabcabc" * 9, np.uint8)
    h = S.gram_hashes(data, 28)
    assert len(h) == len(data) - 27 and (h[:-3] == h[3:]).all() and len(set(h.tolist())) == 3
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
