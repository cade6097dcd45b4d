"""Exact quantiles against a full sort, also when brackets have to be narrowed."""

import random

import numpy as np
import pytest

from plumbline.operators import quantiles


def frames():
    rng = random.Random(3)
    yield "uniform", [rng.uniform(-5, 5) for _ in range(3001)]
    yield "heavy tail", [rng.paretovariate(0.3) for _ in range(3000)]
    yield "hot value", [1.0] * 1500 + [rng.gauss(0, 1) for _ in range(1500)]
    yield "hot at rank border", [1.0] * 1500 + [2.0 + i for i in range(1500)]
    yield "two values", [0.0, 1.0] * 700
    yield "constant", [4.5] * 900
    yield "huge range", [10.0 ** rng.randint(-300, 300) for _ in range(2000)]
    yield "negative zero", [-0.0, 0.0] * 300 + [1.0] * 599


@pytest.mark.parametrize("direct", [5, 200, 10_000])
@pytest.mark.parametrize("name,values", list(frames()), ids=lambda v: v if isinstance(v, str) else "")
def test_matches_full_sort(spark, monkeypatch, direct, name, values):
    monkeypatch.setattr(quantiles, "RANK_DIRECTLY", direct)
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", 50)
    monkeypatch.setattr(quantiles, "GRID", 16)
    df = spark.createDataFrame([(v,) for v in values + [None] * 7], "v double").repartition(4)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, {"v": probs})["v"]
    assert found == pytest.approx([float(np.quantile(values, p)) for p in probs], rel=1e-12, abs=1e-300)


def test_several_columns_and_absent_values(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (4, None, 8.0)], "a int, b double, c double")
    found = quantiles.exact_quantiles(df, {"a": [0.5], "b": [0.5, 0.9], "c": [0.5]})
    assert found == {"a": [2.0], "b": [None, None], "c": [5.0]}
    assert quantiles.exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}
    assert quantiles.exact_quantiles(df, {}) == {}
