"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled rows, labels every
byte position of every text, and a document's probabilities are the mean over all its positions. The state starts
anew every ``STEPS`` bytes in either direction, so a text of any length is read whole, many pieces at a time.

A text that is null or has no letter is ``und`` with score 0. Labels that are null are not learned from. Without a
labelled row every text is ``und``. Rows that repeat an id are predicted one by one. An empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.texts import Texts, texts_of

# Documents per language and pieces per document that the network is fitted on, at most.
SAMPLE_DOCUMENTS, SAMPLE_PIECES = 300, 2
STEPS = 64
HIDDEN = 8
EPOCHS, BATCH, RATE = 10, 128, 0.03
# Pieces that are read side by side.
WIDTH = 2048
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True


@dataclass
class Network:
    """Gate inputs of each byte, recurrent weights of each direction, and the weights of the labels."""

    languages: list[str]
    inputs: np.ndarray  # direction, byte, gates z r n of HIDDEN each
    recurrent: np.ndarray  # direction, HIDDEN, gates
    out: np.ndarray  # both directions' states and one, languages


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(x: np.ndarray, inputs: np.ndarray, recurrent: np.ndarray):
    """States after each step of ``x`` (steps, pieces) and what the way back needs."""
    k = recurrent.shape[0]
    h = np.zeros((x.shape[1], k), np.float32)
    states, kept = [], []
    for step in x:
        a, u = inputs[step], h @ recurrent
        zr = sigmoid(a[:, :2 * k] + u[:, :2 * k])
        z, r = zr[:, :k], zr[:, k:]
        n = np.tanh(a[:, 2 * k:] + r * u[:, 2 * k:])
        kept.append((h, z, r, n, u[:, 2 * k:]))
        h = n + z * (h - n)
        states.append(h)
    return np.stack(states), kept


def backward(x: np.ndarray, grads: np.ndarray, kept: list, inputs: np.ndarray, recurrent: np.ndarray):
    """Gradients of the gate inputs and recurrent weights, given those of the states."""
    k = recurrent.shape[0]
    d_recurrent = np.zeros_like(recurrent)
    d_inputs = np.zeros_like(inputs)
    carry = np.zeros((x.shape[1], k), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, u = kept[t]
        d = grads[t] + carry
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * u * r * (1 - r)
        d_u = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_recurrent += h.T @ d_u
        carry = d * z + d_u @ recurrent.T
        np.add.at(d_inputs, x[t], np.concatenate([d_z, d_r, d_n], axis=1))
    return d_inputs, d_recurrent


def train(pieces: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 7) -> Network:
    """Fit on pieces (rows of STEPS bytes) with the number of each one's language."""
    rng = np.random.default_rng(seed)
    k, n_lang = HIDDEN, len(languages)
    p = [
        rng.normal(0, 0.3, (2, 256, 3 * k)).astype(np.float32), rng.normal(0, 0.3, (2, k, 3 * k)).astype(np.float32),
        rng.normal(0, 0.3, (2 * k + 1, n_lang)).astype(np.float32)]
    first, second = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces))
        for lo in range(0, len(order), BATCH):
            chosen = order[lo:lo + BATCH]
            x = pieces[chosen].T
            ahead, kept_a = forward(x, p[0][0], p[1][0])
            back, kept_b = forward(x[::-1], p[0][1], p[1][1])
            h = np.concatenate([ahead, back[::-1], np.ones((*x.shape, 1), np.float32)], axis=2)
            logits = h @ p[2]
            prob = np.exp(logits - logits.max(axis=2, keepdims=True))
            prob /= prob.sum(axis=2, keepdims=True)
            prob[:, np.arange(len(chosen)), labels[chosen]] -= 1
            d_logits = prob / prob[..., 0].size
            d_out = h.reshape(-1, 2 * k + 1).T @ d_logits.reshape(-1, n_lang)
            d_h = d_logits @ p[2].T
            in_a, rec_a = backward(x, d_h[..., :k], kept_a, p[0][0], p[1][0])
            in_b, rec_b = backward(x[::-1], d_h[::-1, :, k:2 * k], kept_b, p[0][1], p[1][1])
            step += 1
            for w, g, m, v in zip(p, (np.stack([in_a, in_b]), np.stack([rec_a, rec_b]), d_out), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Network(languages, *p)


class Reader:
    """A trained network arranged for reading: both directions in one step, one row for each gate and unit."""

    def __init__(self, net: Network):
        k = HIDDEN
        self.net = net
        scale = np.r_[np.full(2 * k, 0.5), np.ones(k)].astype(np.float32)
        # Gates in the order z ahead, z back, r ahead, r back, n ahead, n back; sigmoids as halved tanh.
        self.tables = [np.ascontiguousarray((net.inputs[d] * scale).T) for d in range(2)]
        self.weights = np.zeros((6 * k, 2 * k), np.float32)
        for d in range(2):
            rows = np.concatenate([np.arange(k) + 2 * k * g + k * d for g in range(3)])
            self.weights[rows, k * d:k * d + k] = (net.recurrent[d] * scale).T

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (languages, steps, pieces) of bytes ``x`` (steps, pieces)."""
        k = HIDDEN
        steps, n = x.shape
        x = x.astype(np.intp)
        h = np.zeros((2 * k, n), np.float32)
        a = np.empty((6 * k, n), np.float32)
        u = np.empty((6 * k, n), np.float32)
        states = np.empty((2 * k, steps, n), np.float32)
        zr, new = a[:4 * k], u[4 * k:]
        z, r = a[:2 * k], a[2 * k:4 * k]
        for t in range(steps):
            for d, at in enumerate((t, steps - 1 - t)):
                byte = x[at]
                for g in range(3):
                    lo = 2 * k * g + k * d
                    np.take(self.tables[d][k * g:k * g + k], byte, axis=1, out=a[lo:lo + k], mode="clip")
            np.matmul(self.weights, h, out=u)
            zr += u[:4 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            new *= r
            new += a[4 * k:]
            np.tanh(new, out=new)
            h -= new
            h *= z
            h += new
            states[:k, t], states[k:, steps - 1 - t] = h[:k], h[k:]
        out = self.net.out
        p = out[:2 * k].T @ states.reshape(2 * k, -1)
        p += out[2 * k][:, None]
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p.reshape(-1, steps, n)

    def read(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (steps, pieces, languages)."""
        return self.probabilities(x).transpose(1, 2, 0)

    def label(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Summed probabilities, and positions labelled, of each text and language."""
        sizes = np.diff(texts.offsets)
        n = -(-sizes // STEPS)
        owner = np.repeat(np.arange(len(texts)), n)
        index = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = texts.offsets[:-1][owner] + index * STEPS
        length = np.minimum(STEPS, texts.offsets[1:][owner] - begin)
        padded = np.r_[texts.data, np.zeros(STEPS, np.uint8)]
        langs = len(self.net.languages)
        sums, votes = np.zeros((len(texts), langs)), np.zeros((len(texts), langs), np.int64)
        # Pieces shorter than the rest are read by themselves, so that no piece sees what is not its text.
        whole = np.flatnonzero(length == STEPS)
        groups = [whole[a:a + WIDTH] for a in range(0, len(whole), WIDTH)]
        rest = np.flatnonzero(length < STEPS)
        for size in np.unique(length[rest]):
            groups.append(rest[length[rest] == size])
        for chosen in groups:
            if not len(chosen):
                continue
            size = int(length[chosen[0]])
            x = padded[begin[chosen][None, :] + np.arange(size)[:, None]]
            p = self.probabilities(x)
            best = (p == p.max(axis=0)).sum(axis=1)
            np.add.at(sums, owner[chosen], p.sum(axis=1, dtype=np.float64).T)
            np.add.at(votes, owner[chosen], best.T)
        return sums, votes


def has_letter(texts: Texts) -> np.ndarray:
    found = np.r_[0, np.cumsum(LETTER[texts.data])]
    out = found[texts.offsets[1:]] > found[texts.offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in texts.text(i).decode("utf-8", "replace"))
    return out


def sample(labelled: DataFrame) -> tuple[list[bytes], list[str]]:
    """At most SAMPLE_PIECES pieces of at most SAMPLE_DOCUMENTS texts of each label, spread over each text.

    Texts are chosen by a hash of their id and content, ties as they come.
    """
    ranked = labelled.select("lang", F.xxhash64("id", "text").alias("rank"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("rank"))
    last = (ranked.withColumn("n", order).where(F.col("n") <= SAMPLE_DOCUMENTS)
            .groupBy("lang").agg(F.max("rank").alias("last")).collect())
    if not last:
        return [], []
    limits = F.create_map(*[F.lit(x) for row in last for x in (row["lang"], row["last"])])
    chosen = labelled.where(F.xxhash64("id", "text") <= limits[F.col("lang")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, pieces = [], []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = text.encode()
                room = max(0, len(data) - STEPS)
                for k in range(SAMPLE_PIECES):
                    at = room * (2 * k + 1) // (2 * SAMPLE_PIECES)
                    langs.append(lang)
                    pieces.append(data[at:at + STEPS])
            yield pa.record_batch({"lang": pa.array(langs, pa.string()), "piece": pa.array(pieces, pa.binary())})

    rows = chosen.select("lang", "text").mapInArrow(cut, "lang string, piece binary")
    # Copies share a rank, so a frequent text could exceed the bound: each piece counts once.
    rows = rows.distinct().orderBy("lang", "piece").collect()
    return [bytes(r["piece"]) for r in rows], [r["lang"] for r in rows]


def fitted(labelled: DataFrame) -> Network | None:
    pieces, langs = sample(labelled)
    whole = [(p, lang) for p, lang in zip(pieces, langs) if len(p) > 1]
    if not whole:
        return None
    languages = sorted({lang for _, lang in whole})
    x = np.zeros((len(whole), STEPS), np.uint8)
    for row, (p, _) in zip(x, whole):
        repeated = p * (STEPS // len(p) + 1)
        row[:] = np.frombuffer(repeated[:STEPS], np.uint8)
    y = np.array([languages.index(lang) for _, lang in whole])
    return train(x, y, languages)


def identified(
    docs: DataFrame, training: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, positions.

    score is the mean probability of lang_pred over the positions, positions how many of them each language,
    in alphabetical order, is most probable at.
    """
    rows = docs.select(
        F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"),
        F.coalesce(training, F.lit(False)).alias("training"))
    net = fitted(rows.where("training and lang is not null and text is not null"))
    reader = Reader(net) if net else None
    kind = rows.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, positions = [], [], []
            for texts in texts_of(batch.column(1), 4 << 20):
                if reader is None:
                    names += [UNKNOWN] * len(texts)
                    scores += [0.0] * len(texts)
                    positions += [[]] * len(texts)
                    continue
                sums, votes = reader.label(texts)
                lettered = has_letter(texts)
                mean = sums / np.maximum(np.diff(texts.offsets), 1)[:, None]
                best = mean.argmax(axis=1)
                for i in range(len(texts)):
                    names.append(reader.net.languages[best[i]] if lettered[i] else UNKNOWN)
                    scores.append(min(1.0, float(mean[i, best[i]])) if lettered[i] else 0.0)
                    positions.append(votes[i].tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(positions, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "positions"])

    return rows.select("id", "text", (~F.col("training")).alias("held_out")).mapInArrow(
        predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double, positions array<long>")
