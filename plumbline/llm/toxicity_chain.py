"""Toxicity categories predicted one after another by a chain of linear classifiers.

The chain follows the order of the categories given. Each model sees which telling words, and beginnings of longer words,
a text holds, how it is shaped (length, symbols, repeats, each in steps), and the log odds that the models before it gave. While it is trained, those odds come from models that did not see the
document: every model is fitted once per fold on the other folds, and once on all for use.

Models are fitted on at most ``SAMPLE`` labelled documents, the ones with the smallest hash of their id. All documents
are scored, whole. Null texts hold no words. A document labelled several times has a category if any of its
labels says so; null labels and labels without a document are left out. Without labels every probability is 0 and
nothing is marked. Rows that repeat an id are scored one by one. An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.host_quality import measures
from plumbline.llm.texts import Texts, mixed, texts_of, word_bounds, word_hashes

SAMPLE = 12_000
FOLDS = 5
SPACE_BITS = 20
PREFIX = 5
# A feature is used if its documents are at least so many and lean to one side by so many standard errors.
LEAST_DOCUMENTS, LEAST_LEAN = 4, 5.0
RIDGE, ROUNDS = 5e-5, 400


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word, every word beginning and each text's shape, with repeats.

    Words are letter runs as far as ASCII punctuation goes: it ends a word like white space does.
    """
    data = texts.data.copy()
    data[PUNCTUATION[data]] = 32
    plain = Texts(texts.first, data, texts.offsets)
    starts, ends = word_bounds(plain)
    owner = plain.owner(starts)
    long = ends - starts > PREFIX
    begin = word_hashes(plain, starts[long], starts[long] + PREFIX) + np.uint64(1)
    form = shapes(texts)
    h = np.concatenate([word_hashes(plain, starts, ends), mixed(begin), mixed(form.ravel())])
    owner = np.concatenate([owner, owner[long], np.repeat(np.arange(len(texts)), form.shape[1])])
    return owner, (h >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def shapes(texts: Texts) -> np.ndarray:
    """A number for each text and kind of shape, distinct over kinds and steps."""
    n_words, chars, symbols, lines, dup_lines, repeats = measures(texts)
    n = np.maximum(n_words, 1)
    steps = [np.log2(n_words + 1), 10 * symbols / n, chars / n, 10 * dup_lines / np.maximum(lines, 1), 10 * repeats / n]
    steps = [np.minimum(s, 30).astype(np.uint64) + np.uint64(32 * k + 1) for k, s in enumerate(steps)]
    return np.stack(steps, axis=1)


PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def distinct_pairs(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(owner * (1 << SPACE_BITS) + feature)
    return pairs >> SPACE_BITS, pairs & ((1 << SPACE_BITS) - 1)


def telling(owner: np.ndarray, feature: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Features whose documents hold the category more or less often than others, beyond chance."""
    n = np.bincount(feature, minlength=1 << SPACE_BITS)
    k = np.bincount(feature, weights=y[owner], minlength=1 << SPACE_BITS)
    share = y.mean()
    lean = np.abs(k - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))
    return np.flatnonzero((n >= LEAST_DOCUMENTS) & (lean >= LEAST_LEAN))


def logistic(owner, column, extra: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """Ridge logistic regression on 0/1 columns and dense ``extra`` ones; bias last. Full-batch Adam."""
    w = np.zeros(width + extra.shape[1] + 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 0
    for t in range(1, ROUNDS + 1):
        z = np.bincount(owner, weights=w[column], minlength=len(y)) + extra @ w[width:-1] + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        g = np.concatenate([
            np.bincount(column, weights=error[owner], minlength=width), extra.T @ error, [error.sum()]]) + ridge * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


class Linear:
    """One model of the chain: weights of telling features, of the odds before it, and a bias."""

    def __init__(self, owner, feature, before: np.ndarray, y: np.ndarray):
        self.chosen = telling(owner, feature, y)
        at = np.searchsorted(self.chosen, feature)
        at[at == len(self.chosen)] = 0
        hit = self.chosen[at] == feature if len(self.chosen) else np.zeros(len(feature), bool)
        w = logistic(owner[hit], at[hit], before, y, len(self.chosen))
        self.weights, self.before, self.bias = w[:len(self.chosen)], w[len(self.chosen):-1], w[-1]

    def odds(self, owner, feature, before: np.ndarray, n: int) -> np.ndarray:
        """Log odds of each of ``n`` documents, from distinct (document, feature) pairs."""
        z = np.full(n, self.bias) + before @ self.before
        if len(self.chosen):
            at = np.searchsorted(self.chosen, feature)
            at[at == len(self.chosen)] = 0
            hit = self.chosen[at] == feature
            z += np.bincount(owner[hit], weights=self.weights[at[hit]], minlength=n)
        return np.clip(z, -12, 12)


def out_of_fold(owner, feature, before: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y))
    for k in range(FOLDS):
        own = fold == k
        number = np.cumsum(~own) - 1
        seen = ~own[owner]
        model = Linear(number[owner[seen]], feature[seen], before[~own], y[~own])
        out[own] = model.odds(owner, feature, before, len(y))[own]
    return out


def fit_chain(owner, feature, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per column of ``labels``, in order."""
    before, chain = np.zeros((len(labels), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(float)
        chain.append(Linear(owner, feature, before, y))
        before = np.column_stack([before, out_of_fold(owner, feature, before, y, fold)])
    return chain


def chain_odds(chain: list[Linear], owner, feature, n: int) -> np.ndarray:
    before = np.zeros((n, 0))
    for model in chain:
        before = np.column_stack([before, model.odds(owner, feature, before, n)])
    return before


def fitted(docs: DataFrame, labels: DataFrame, categories: Sequence[str]) -> list[Linear]:
    """The chain learned from ``docs`` (id, text) and ``labels`` (id and a 0/1 column per category)."""
    known = labels.where(F.col("id").isNotNull()).groupBy("id").agg(*[F.max(c).alias(c) for c in categories])
    known = known.na.drop().orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    # At most SAMPLE small rows.
    rows = docs.join(F.broadcast(known), "id").select("id", "text", *categories)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in texts_of(batch.column(1)):
                owner, feature = distinct_pairs(*features(texts))
                edges = np.searchsorted(owner, np.arange(len(texts) + 1))
                found += [feature[a:b].astype(np.int32).tobytes() for a, b in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]],
                names=["id", "found", *categories])

    schema = "id long, found binary, " + ", ".join(f"{c} int" for c in categories)
    sample = rows.mapInArrow(extract, schema).dropDuplicates(["id"]).orderBy("id").toPandas()
    if not len(sample):
        return []
    parts = [np.frombuffer(x, np.int32) for x in sample["found"]]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    feature = np.concatenate(parts).astype(np.int64)
    fold = (mixed(sample["id"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(FOLDS)).astype(int)
    return fit_chain(owner, feature, sample[list(categories)].to_numpy(int), fold)


def scored(docs: DataFrame, labels: DataFrame, categories: Sequence[str], id_column: str = "doc_id",
           text: str = "text", label_id: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: doc_id and, for each category, p_<category> and whether it is over a half.

    ``labels`` has a 0/1 column per category; they are predicted in the order given.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = labels.select(F.col(label_id).cast("long").alias("id"), *[F.col(c).cast("int") for c in categories])
    chain = fitted(rows, known, categories)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = [np.zeros((0, len(categories)))]
            for texts in texts_of(batch.column(1)):
                if not chain:
                    odds.append(np.full((len(texts), len(categories)), -np.inf))
                    continue
                odds.append(chain_odds(chain, *distinct_pairs(*features(texts)), len(texts)))
            p = 1 / (1 + np.exp(-np.concatenate(odds)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(p[:, k]) for k in range(len(categories))],
                names=["doc_id", *[f"p_{c}" for c in categories]])

    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in categories)
    return rows.mapInArrow(predict, schema).select(
        "*", *[(F.col(f"p_{c}") > 0.5).alias(c) for c in categories])
