import random

import numpy as np

from plumbline.llm import toxicity_chain as C

BAD = ["idiot", "moron", "scum"]


def made(rng, n=80, bad=0):
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]
    for _ in range(bad):
        words.insert(rng.randint(0, len(words)), rng.choice(BAD) + rng.choice(["", "ic", "ish", "."]))
    return " ".join(words)


def corpus(seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(900):
        toxic, junk = k % 9 == 0, k % 7 == 0
        text = made(rng, rng.randint(20, 200), 3 if toxic else 0)
        docs.append((k, text.replace(" ", " | ") if junk else text))
        if k % 4:
            labels.append((k, int(junk), int(toxic)))
    return docs, labels


DOC, LABEL = "doc_id long, text string", "doc_id long, low_quality int, toxic int"


def test_planted_words_are_found_and_the_rest_left_alone(spark):
    docs, labels = corpus()
    found = C.scored(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), ["low_quality", "toxic"]).collect()
    assert {r.doc_id for r in found if r.toxic} == {k for k in range(900) if k % 9 == 0}
    assert {r.doc_id for r in found if r.low_quality} == {k for k in range(900) if k % 7 == 0}


def test_odd_rows(spark):
    docs, labels = corpus()
    rows = [(1000, None), (1001, ""), (1002, "idiot moron scum"), (1002, "idiot moron scum"), (None, "idiot moron"),
            (1003, "fine " * 50_000), (1004, "idiot moron scum " * 20_000)]
    labels += [(1000, 0, 1), (None, 1, 1), (77, 0, None), (4444, 1, 1), (5, 0, 0), (5, 0, 0)]
    frame = spark.createDataFrame([(i, t, 0.5, "z") for i, t in docs + rows], DOC + ", p_toxic double, found string")
    found = C.scored(frame, spark.createDataFrame(labels, LABEL), ["low_quality", "toxic"]).collect()
    assert len(found) == len(docs) + len(rows)
    by = {r.doc_id: r for r in found}
    assert by[1002].toxic and by[1004].toxic and not by[1003].toxic and not by[1001].toxic
    assert all(0 <= r.p_toxic <= 1 for r in found)
    none = C.scored(frame, spark.createDataFrame([], LABEL), ["toxic"]).collect()
    assert all(r.p_toxic == 0 and not r.toxic for r in none)
    assert C.scored(frame.limit(0), spark.createDataFrame(labels, LABEL), ["toxic"]).count() == 0


def test_later_models_are_fed_out_of_fold_odds():
    """The second category follows the first; without words of its own it is read off the first model's odds."""
    rng = np.random.default_rng(0)
    n = 400
    y = rng.random(n) < 0.4
    owner, feature = np.flatnonzero(y), np.full(int(y.sum()), 7)
    noise = np.arange(n)
    owner, feature = np.concatenate([owner, noise]), np.concatenate([feature, 1000 + noise])
    fold = noise % C.FOLDS
    out = C.out_of_fold(owner, feature, np.zeros((n, 0)), y.astype(float), fold)
    assert ((out > 0) == y).all()
    chain = C.fit_chain(owner, feature, np.column_stack([y, y]).astype(int), fold)
    assert len(chain[1].before) == 1 and chain[1].before[0] > 0
    odds = C.chain_odds(chain, owner, feature, n)
    assert ((odds[:, 1] > 0) == y).all()


def test_a_fold_does_not_see_its_own_labels():
    n = 200
    y = (np.arange(n) % 2).astype(float)
    owner = np.arange(n)
    out = C.out_of_fold(owner, owner + 5, np.zeros((n, 0)), y, np.arange(n) % C.FOLDS)
    assert np.abs(out).max() < 0.2
