import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import byte_gru as G
from plumbline.llm.queries import QUERIES


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    k = G.HIDDEN
    x = rng.integers(97, 101, (5, 3))
    inputs, recurrent = rng.normal(0, 0.5, (256, 3 * k)), rng.normal(0, 0.5, (k, 3 * k))
    weight = rng.normal(0, 1, (5, 3, k))

    def loss():
        return float((G.forward(x, inputs, recurrent)[0] * weight).sum())

    _, kept = G.forward(x, inputs, recurrent)
    d_inputs, d_recurrent = G.backward(x, weight, kept, inputs, recurrent)
    for array, grad, places in ((inputs, d_inputs, [(97, 0), (98, k + 1), (99, 2 * k + 2)]), (
            recurrent, d_recurrent, [(0, 1), (3, k), (2, 2 * k + 5)])):
        for at in places:
            old = array[at]
            array[at] = old + 1e-4
            up = loss()
            array[at] = old - 1e-4
            down = loss()
            array[at] = old
            assert abs((up - down) / 2e-4 - grad[at]) < 1e-3


def test_reader_agrees_with_the_trained_network():
    rng = np.random.default_rng(2)
    k = G.HIDDEN
    net = G.Network(["x", "y"], rng.normal(0, 0.5, (2, 256, 3 * k)).astype(np.float32),
                    rng.normal(0, 0.5, (2, k, 3 * k)).astype(np.float32), rng.normal(0, 1, (2 * k + 1, 2)).astype(np.float32))
    x = rng.integers(0, 256, (20, 7))
    ahead, _ = G.forward(x, net.inputs[0], net.recurrent[0])
    back, _ = G.forward(x[::-1], net.inputs[1], net.recurrent[1])
    z = np.exp(np.concatenate([ahead, back[::-1], np.ones((20, 7, 1))], axis=2) @ net.out)
    assert np.allclose(G.Reader(net).read(x), z / z.sum(axis=2, keepdims=True), atol=1e-4)


def test_query_on_held_out_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = QUERIES["op10_byte_gru"](spark, sf_dir).collect()
    assert {r.doc_id for r in found} == set(truth) and len(found) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)


def made(lang, rng, n=60):
    letters = {"aa": "abcdefg", "bb": "stuvwxéü"}[lang]
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def test_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, made(lang, rng), lang, "s") for k, lang in enumerate(["aa", "bb"] * 40)]
    odd = [(900, None, "aa", "s"), (901, "", None, "s"), (902, "123 -- ;", "bb", "s"), (903, "é", None, None), (903, "é", None, None),
           (904, made("bb", rng, 20_000), None, "s"), (None, made("aa", rng), None, "s"), (905, "١٢٣ 。", None, "s")]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows + odd, schema).withColumn("training", F.lit(1))
    found = [r for r in G.identified(docs, F.col("doc_id") % 5 != 0).collect()]
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    assert len(found) == len(rows) + len(odd)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (900, 901, 902, 905))
    assert [r.lang_pred for r in by[903]] == ["bb", "bb"] and by[904][0].lang_pred == "bb" and by[None][0].lang_pred == "aa"
    assert sum(by[904][0].positions) >= len(odd[5][1].encode())
    assert np.mean([by[i][0].lang_pred == lang for i, _, lang, _ in rows]) > 0.95
    assert G.identified(docs.limit(0), F.lit(True)).count() == 0
    untaught = G.identified(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_sample_is_bounded_and_ignores_held_out_rows(spark):
    rng = random.Random(3)
    rows = [(k, made("aa", rng, 5), "aa") for k in range(1000)] + [(5000, made("bb", rng), "bb")] * 700
    pieces, langs = G.sample(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert langs.count("aa") <= G.SAMPLE_DOCUMENTS * G.SAMPLE_PIECES and 0 < langs.count("bb") <= G.SAMPLE_PIECES
    assert all(len(p) <= G.STEPS for p in pieces)
