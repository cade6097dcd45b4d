import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing as P

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)


@settings(deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(
    st.tuples(st.integers(1, c), st.integers(0, 30)), max_size=20))))
def test_every_piece_has_a_place(case):
    capacity, pairs = case
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pairs:
        counts[length] += n
    patterns = P.solve(counts, capacity)
    held = np.zeros_like(counts)
    for p in patterns:
        assert p.bins > 0 and sum(n * c for n, c in p.parts) <= capacity
        for n, c in p.parts:
            held[n] += c * p.bins
    assert (held == counts).all()


def fewest(items, capacity):
    """Exact, by trying all ways."""
    best = len(items)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(items):
            best = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[k] <= capacity:
                place(k + 1, [*bins[:b], bins[b] + items[k], *bins[b + 1:]])
        place(k + 1, [*bins, items[k]])

    place(0, [])
    return best


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(1, 12), max_size=8))
def test_fixed_sets_lose_nothing(items):
    """The sets that are fixed as dominating are part of some best packing."""
    items = sorted(items, reverse=True)
    counts = np.bincount(items, minlength=13).astype(np.int64) if items else np.zeros(13, np.int64)
    fixed = P.dominant_sets(counts, 12)
    rest = [n for n in range(12, 0, -1) for _ in range(counts[n])]
    assert sum(p.bins for p in fixed) + fewest(rest, 12) == fewest(items, 12)


@settings(deadline=None, max_examples=200)
@given(st.text(max_size=80) | st.text(alphabet="aB'sté  ́ \n<|endoftext|>ΣΐΑ9", max_size=60))
def test_words_by_themselves_give_the_ids_of_the_text(text):
    ids = np.frombuffer(P.encoder(PATH).encode([text.encode()])[0], "<u4").tolist()
    assert ids == WHOLE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packed(spark, capacity):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "some words"), (4, "word " * 3000), (5, "x" * 70_000)]
    rows += [(k, "few words here " * (k % 9)) for k in range(10, 80)]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, row int, length int")
    found = P.packed(docs, PATH, capacity=capacity).collect()
    expected = []
    for i, t in rows:
        ids = WHOLE.encode(t or "", add_special_tokens=False).ids + [0]
        expected += [(i or -1, k, at, ids[at:at + capacity]) for k, at in enumerate(range(0, len(ids), capacity))]
    got = [(r.doc_id or -1, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found]
    assert sorted(got) == sorted(expected)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    total = sum(len(e[3]) for e in expected)
    assert len(sequences) <= -(-total // capacity) * 1.1 + 1
    assert P.packed(docs.limit(0), PATH).count() == 0


def test_ids_of_every_kind_of_word():
    """Words remembered by parts or whole have the ids of the whole text, whatever was encoded before."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = ["<|EndOfText|>", "<|endoftext|>", "J\u030cak", "T\u0308.", "t\u0308", "\u01c6x", "\u0130stanbul,", "\u039f\u0394\u039f\u03a3.",
           "it's", "x\u00b2!", "\u0661\u0662.", "a|b|", "word|", "|", "...", "$5.00", "a_b.", "na\u00efve)", "\ufb01ne.", "\u1e9e", "K\u212a", "e\u0301t\u0301,"]
    rng = random.Random(4)
    pieces = ["a", "B", "\u00e9", "\u00c9", "e", "\u0301", "\u030c", "1", ".", ",", "|", "<", ">", "'", "s", "\u0130", "\u03a3", "$", "_", "\u4e2d"]
    odd += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    texts = [" ".join(rng.choice(odd) for _ in range(30)) for _ in range(200)] + odd
    texts = ["plain words only here. Again, plain words!"] * 3000 + texts
    found = P.Encoder(path).encode([t.encode() for t in texts])
    for text, ids in zip(texts[3000:], found[3000:]):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


class Counting:
    """A tokenizer that notes the words it is given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, words, add_special_tokens):
        self.seen += words
        return self.tokenizer.encode_batch_fast(words, add_special_tokens=add_special_tokens)


def test_words_of_small_letters_reach_the_model_at_once():
    rng = random.Random(5)
    words = ["".join(rng.choice(P.SMALL) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    encoder = P.Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    found = encoder.encode([w.encode() for w in words])
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == [
        WHOLE.encode(w, add_special_tokens=False).ids for w in words]
    assert not encoder.tokenizer.seen


def test_words_met_all_the_time_stay_remembered(monkeypatch):
    monkeypatch.setattr(P, "REMEMBERED", 2000)
    encoder = P.Encoder(PATH)
    encoder.tokenizer = Counting(encoder.tokenizer)
    for k in range(100):
        text = " ".join(["often-met", *(f"{k}-{i}" for i in range(100))])
        ids = np.frombuffer(encoder.encode([text.encode()])[0], "<u4").tolist()
        assert ids == WHOLE.encode(text, add_special_tokens=False).ids
    assert encoder.tokenizer.seen.count("often-met") == 1
    assert len(encoder.known) + len(encoder.known.before) <= 2000
