"""Whitening against numpy, with hostile vectors."""

import math

import numpy as np
import pytest

from trackloom.llm import whiten as wh

KIND = "vec_id bigint, embedding array<double>, extra string, _x int"


def table(spark, vectors):
    rows = [(i, v, "x", 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, KIND)


def expected(vectors, k=4):
    x = np.array([[math.floor(256 * c) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted({tuple(r) for r in x.tolist()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = np.array([[float(n * c - t) / n for c, t in zip(r, s)] for r in fit.tolist()])
    v = y.T @ y / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    z = np.array([[float(n * c - t) / n for c, t in zip(r, s)] for r in x.tolist()])
    return n, [sum((n * c - t) ** 2 for c, t in zip(r, s)) for r in x.tolist()], z @ q / np.sqrt(e), e / np.trace(v)


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    return (rng.standard_normal((400, 24)) * np.geomspace(3, 0.2, 24)) @ turn + 5


def test_equals_numpy(spark, cloud):
    vectors = [v.tolist() for v in cloud] + [cloud[7].tolist()] * 50  # copies count once in the fit
    vectors += [None, [1.0, None] + [0.0] * 22, [float("nan")] + [0.0] * 23, [float("inf")] + [0.0] * 23]
    got = wh.whiten(table(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    n, deviation, white, explained = expected(vectors[:450])
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert len(got) == 450 * 4 and set(got.n) == {n} == {400}
    assert got.deviation.tolist() == [d for d in deviation for _ in range(4)]
    z = got.whitened.to_numpy().reshape(-1, 4)
    assert np.abs(np.abs(z) - np.abs(white)).max() < 1e-9
    assert np.abs(np.sign(z[0] * white[0]) * white - z).max() < 1e-9  # one sign for all rows
    assert np.abs(got.explained.to_numpy().reshape(-1, 4) - explained).max() < 1e-12
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def test_reruns_and_order_agree(spark, cloud):
    a = wh.whiten(table(spark, [v.tolist() for v in cloud])).toPandas().sort_values(["vec_id", "component"])
    b = wh.whiten(table(spark, [v.tolist() for v in cloud]).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    assert np.abs(a.whitened.to_numpy() - b.whitened.to_numpy()).max() < 1e-9


def test_few_dimensions_and_no_variance(spark):
    line = wh.whiten(table(spark, [[float(i), 2.0 * i, 0.0] for i in range(10)])).toPandas()
    assert set(line.component) == {1} and abs(line.explained[0] - 1) < 1e-12
    assert wh.whiten(table(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert wh.whiten(table(spark, [[1.0, 2.0]])).count() == 0
    assert wh.whiten(table(spark, [None, [None]])).count() == 0
    assert wh.whiten(table(spark, [])).count() == 0
    assert wh.whiten(table(spark, [[], []])).count() == 0


def test_short_vectors_and_null_ids(spark):
    rows = [(None, [1.0, 2.0], "", 0), (1, [3.0], "", 0), (1, [0.5, -1.0], "", 0), (2, [0.0, 0.25], "", 0)]
    got = wh.whiten(spark.createDataFrame(rows, KIND)).toPandas()
    n, deviation, _, _ = expected([[1.0, 2.0], [3.0, 0.0], [0.5, -1.0], [0.0, 0.25]])
    assert len(got) == 8 and sorted(got.deviation) == sorted([d for d in deviation for _ in range(2)])
    assert got.vec_id.isna().sum() == 2


def test_large_numbers_stay_exact(spark):
    far = [[4e12 + i, -4e12 + 2 * i, float((i * 7) % 5)] for i in range(40)]
    got = wh.whiten(table(spark, far)).toPandas().sort_values(["vec_id", "component"])
    _, deviation, white, _ = expected(far)
    assert got[got.component == 1].deviation.tolist() == deviation
    assert np.abs(np.abs(got.whitened.to_numpy().reshape(-1, 2)) - np.abs(white[:, :2])).max() < 1e-6
    huge = [[1e300, 0.0], [-1e300, 1.0], [3.0, 2.0]]
    got = wh.whiten(table(spark, huge)).toPandas()
    assert len(got) > 0 and np.isfinite(got.whitened).all() and got.deviation.isna().any()


def test_slow_spectra_are_certified():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.standard_normal((80, 80)))[0]
    for spectrum in (np.linspace(1.02, 0.98, 80), np.ones(80), np.r_[1.0, np.full(79, 1e-9)], np.r_[np.ones(3), np.zeros(77)]):
        a = q * spectrum @ q.T
        values, vectors = wh.leading_eigenvectors(lambda x: a @ x, 80, 4)
        assert np.abs(values - spectrum[:4]).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-11
