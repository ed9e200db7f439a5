"""Whitened embeddings against numpy on small tables."""

import gc
import time

import numpy as np
import pytest

from pitchside.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, key string, place long, n long, x string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "clash", 1, 1, "clash") for i, v in vectors], SCHEMA).repartition(3)


def brute(vectors, components=4):
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    white = (x - s / n) @ basis[:, :components] / np.sqrt(values[:components])
    return n, [sum((n * int(c) - int(t)) ** 2 for c, t in zip(r, s, strict=True)) for r in x], white, values / values.sum()


def test_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "BLOCKS", 2)
    r = np.random.default_rng(5)
    vectors = [(i, (r.normal(size=7) * np.arange(7, 0, -1) / 5).tolist()) for i in range(150)]
    vectors += [(200 + i, vectors[3][1]) for i in range(40)] + [(3, vectors[9][1]), (None, vectors[4][1]), (300, [0.0] * 7), (301, [-0.0] * 7)]
    odd = [(400, None), (401, [1.0, None, *[0.0] * 5]), (402, [float("nan")] * 7), (403, [float("inf")] * 7), (404, [])]
    got = whitening.whiten(frame(spark, vectors + odd)).toPandas()
    n, deviations, white, explained = brute(vectors)
    assert len(got) == 4 * len(vectors) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    for c in range(1, 5):
        own = got[got.component == c]
        sign = np.sign(own[own.vec_id == 0].whitened.iloc[0] * white[0, c - 1])
        assert np.allclose(own.explained, explained[c - 1], rtol=1e-9)
        key = lambda i, d, w: (-1 if i is None or i != i else int(i), int(d), round(float(w), 6))
        assert sorted(key(*t) for t in zip(own.vec_id, own.deviation, own.whitened * sign, strict=True)) == sorted(
            key(i, d, w) for (i, _), d, w in zip(vectors, deviations, white[:, c - 1], strict=True))
    assert list(map(int, got.deviation_decimal)) == got.deviation.tolist()


def test_lengths_without_variance_and_large_entries(spark):
    got = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [0.1, 0.2, 0.3]), (4, [0.4, 0.1, 0.3]), (5, [3e38]), (6, [-3e38]), (7, [0.0])])).toPandas()
    rows = {(r.vec_id, r.component): r for r in got.itertuples()}
    assert len(rows) == 2 * 2 + 2 * 3 + 3
    assert rows[1, 1].n == 1 and np.isnan(rows[1, 1].whitened) and rows[2, 2].explained == 0 and rows[1, 1].identity_error == 0 and rows[1, 1].deviation == 0
    assert abs(rows[3, 1].whitened) == pytest.approx(1) and rows[3, 1].whitened == pytest.approx(-rows[4, 1].whitened)
    assert rows[3, 1].explained == pytest.approx(1) and np.isnan(rows[3, 2].whitened)
    assert np.isnan(rows[5, 1].deviation) and abs(rows[5, 1].whitened) > 1


def test_matrices_are_held_while_the_jvm_reads_them(spark, monkeypatch):
    call, held = whitening.callMLlibFunc, []

    def late(name, model):
        gc.collect()
        time.sleep(1)  # what nothing refers to is given up meanwhile
        held.append(model.toString())
        return call(name, model)

    monkeypatch.setattr(whitening, "callMLlibFunc", late)
    got = whitening.whiten(frame(spark, [(i, [float(i), float(i * i % 7), 1.0 / (i + 1)]) for i in range(20)]))
    assert got.count() == 3 * 20 and held


def test_empty(spark):
    got = whitening.whiten(frame(spark, [(1, None)]))
    assert got.count() == 0 and got.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
