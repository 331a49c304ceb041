"""Whitening against numpy's full decomposition; moments against whole numbers of any size."""

import math

import numpy as np
import pytest

from murmur.llm import whitening
from murmur.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, component string, n string"


def symmetric(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    m = (q * np.array(values)) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("n", [1, 2, 3, 10, 60])
def test_counts_are_those_of_all_eigenvalues(n):
    rng = np.random.default_rng(n)
    for _ in range(30):
        m = rng.standard_normal((n, n))
        m = m + m.T
        if rng.random() < 0.3:
            m[np.diag_indices(n)] = 0  # no single pivot will do
        values = np.linalg.eigvalsh(m)
        for shift in rng.standard_normal(5) * 3:
            assert whitening.eigenvalues_above(m, shift) == (values > shift).sum()
    assert whitening.eigenvalues_above(np.zeros((n, n)), 0.0) == 0


@pytest.mark.parametrize("values", [
    [5.0], [3, 2, 1], [4] * 10, [3] * 20 + [2] * 20 + [1] * 5, [1, 1 + 1e-9, 1 + 2e-9, 0.5], [10.0 ** -k for k in range(20)],
    list(np.linspace(1, 100, 60)), [7, 0, 0, 0], [1e-12, 2e-12], [1e12, 3e12, 1],
])
def test_leading_components(values):
    m = symmetric(values)
    got, vectors = whitening.leading_components(m, 32)
    top = np.sort(values)[::-1][:32]
    norm = max(values)
    assert (top > 1.1e-12 * norm).sum() <= len(got) <= (top > 1e-15 * norm).sum()
    assert np.abs(got - top[: len(got)]).max() < 1e-13 * norm * len(values)
    assert np.abs(m @ vectors - vectors * got).max() < 1e-13 * norm * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(got))).max() < 1e-13


def test_nothing_to_find():
    values, vectors = whitening.leading_components(np.zeros((3, 3)), 32)
    assert values.size == 0 and vectors.shape == (3, 0)


@pytest.mark.parametrize("size", [1 << 6, 1 << 19, 1 << 31])
def test_products_are_exact(size):
    y = np.random.default_rng(1).integers(-size, size, (256, 5))
    high, low = whitening.products(y)
    exact = y.astype(object).T @ y.astype(object)
    assert [[(int(h) << 40) + int(x) for h, x in zip(a, b, strict=True)] for a, b in zip(high, low, strict=True)] == exact.tolist()


def test_registered_query(spark):
    rows = table(spark, SF, "embeddings").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in rows], np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    expected = (x - x.mean(axis=0)) @ (vectors[:, :32] / np.sqrt(values[:32]))
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    got = QUERIES["op11_embedding_whitening"].run(spark, SF).collect()
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    w = np.zeros((n, 32))
    place = {r["vec_id"]: i for i, r in enumerate(rows)}
    for r in got:
        i = place[r["vec_id"]]
        w[i, r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[i]
        assert math.isclose(r["explained"], values[r["component"] - 1] / values.sum(), rel_tol=1e-10)
    signs = np.sign((w * expected).sum(axis=0))
    assert np.abs(w * signs - expected).max() < 1e-8
    assert {r["identity_error"] for r in got}.pop() < 1e-10


def test_edge_cases(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(v) for v in rng.standard_normal(3)], "c", "n") for i in range(8)]
    odd = [(None, None, "", ""), (20, [], "", ""), (21, [1.0, None, 2.0], "", ""), (22, [math.nan, 1.0, 1.0], "", ""),
           (23, [math.inf, 1.0, 1.0], "", ""), (24, [1e30, 1.0, 1.0], "", ""), (25, [1.0, 2.0], "", "")]
    repeated = [(None, good[0][1], "", ""), (1, good[1][1], "", "")]
    docs = spark.createDataFrame(good + odd + repeated, VECTORS)
    got = whitening.whiten(docs).collect()
    assert len(got) == 3 * 10 and {r["n"] for r in got} == {10}
    assert sum(r["vec_id"] is None for r in got) == 3
    w = np.array([r["whitened"] for r in got]).reshape(10, 3)
    assert np.abs(w.T @ w / 10 - np.eye(3)).max() < 1e-10 and max(r["identity_error"] for r in got) < 1e-10
    for few in (docs.limit(0), docs.where("vec_id = 20"), docs.where("vec_id = 3"), docs.where("vec_id = 1")):
        assert whitening.whiten(few).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "", "") for i in range(9)], VECTORS)
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}
    assert {r["component"] for r in whitening.whiten(docs, components=2).collect()} == {1, 2}


def test_deviations_beyond_a_long_are_null():
    model = whitening.Whitening(1 << 40, np.array([0]), [5], np.ones((1, 1)), np.ones(1), np.ones(1))
    x = np.array([[1], [-(1 << 30)], [0]])
    assert whitening.deviations(x, model) == [None, None, 25]
    small = model._replace(n=4)
    assert whitening.deviations(x[::2], small) == [1, 25]
