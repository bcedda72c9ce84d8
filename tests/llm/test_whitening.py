"""Whitening against a dense eigensolver and whole-number arithmetic."""
import numpy as np
import pytest

from sigspark.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n long, component string, w double"


def matrix(values, seed=0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(values), len(values))))
    return (q * values) @ q.T


SPECTRA = {"spread": np.arange(1.0, 41) ** 2, "steep": np.exp(np.linspace(-20, 20, 30)), "two clusters": np.r_[np.ones(30), np.full(12, 5.0)], "one cluster": np.full(20, 3.0),
           "null space": np.r_[np.zeros(30), np.arange(1.0, 15)], "mixed signs": np.linspace(-3, 4, 25), "one": np.array([2.0]), "pairs": np.repeat(np.arange(1.0, 20), 2)}


@pytest.mark.parametrize("name", SPECTRA)
def test_eigenpairs(name):
    m = matrix(SPECTRA[name])
    m = (m + m.T) / 2
    want = np.linalg.eigvalsh(m)[::-1][:16]
    values, vectors = w.leading(m, 16)
    top = np.abs(SPECTRA[name]).max()
    assert np.abs(values - want).max() < 1e-13 * top
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(m @ vectors - vectors * values).max() < 1e-11 * top


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia(name):
    m = matrix(SPECTRA[name], 1)
    bands = w.tridiagonal((m + m.T) / 2)
    for shift in (-10.0, -0.51, 0.77, 2.53, 4.51, 17.3, 1e9):
        assert w.above(bands, shift) == (SPECTRA[name] > shift).sum()


def test_missed_pairs_are_told():
    with pytest.raises(ArithmeticError):
        w.feast(np.diag([1.0, 2.0, 3.0]), 0.5, 2.5, 3)


def test_against_dense(spark):
    rng = np.random.default_rng(5)
    rows = [(k, (rng.normal(size=6) * [5, 3, 1, 1, 0.2, 0]).tolist(), 1, "x", 2.0) for k in range(300)]
    odd = [(900, None, 0, "", 0.0), (901, [1.0] * 5 + [None], 0, "", 0.0), (902, [float("nan")] * 6, 0, "", 0.0), (903, [float("inf")] + [0.0] * 5, 0, "", 0.0), (904, [1.0, 2.0], 0, "", 0.0), (905, [], 0, "", 0.0)]
    more = [(None, rows[0][1], 0, "", 0.0), (7, rows[1][1], 0, "", 0.0), (7, rows[1][1], 0, "", 0.0)]
    found = w.whiten(spark.createDataFrame(rows + odd + more, SCHEMA)).toPandas()
    kept = rows + more
    x = np.floor(64 * np.float32([r[1] for r in kept]).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:5], vectors[:, ::-1][:, :5]
    assert len(found) == 5 * n and set(found["n"]) == {n} and found["identity_error"].nunique() == 1 and found["identity_error"].iat[0] < 1e-9
    white, deviation = y @ vectors / np.sqrt(values), ((n * x - s) ** 2).sum(axis=1)
    for k in range(5):
        part = found[found["component"] == k + 1]
        assert np.allclose(part["explained"], values[k] / np.trace(y.T @ y / n), rtol=1e-9)
        got = sorted(zip(part["deviation"], part["whitened"]))
        for sign in (1, -1):
            if np.allclose(sorted(sign * white[:, k]), sorted(v for _, v in got), atol=1e-9):
                break
        else:
            raise AssertionError(k)
        assert sorted(part["deviation"]) == sorted(deviation)
    assert sorted(found[found["component"] == 1]["vec_id"].dropna().astype(int)) == sorted(r[0] for r in kept if r[0] is not None)


def test_deviation_past_64_bits(spark):
    rows = [(0, [1e12, 0.0]), (1, [-1e12, 1.0]), (2, [3.0, 2.0])]
    found = w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").orderBy("vec_id").collect()
    x = [[int(64 * a // 1) + 1_000_000, int(64 * b) + 1_000_000] for _, (a, b) in rows]
    sums = [sum(c) for c in zip(*x)]
    exact = [sum((3 * v - s) ** 2 for v, s in zip(r, sums)) for r in x]
    assert [int(r.deviation_exact) for r in found] == exact
    assert [r.deviation for r in found] == [d if d < 1 << 63 else None for d in exact]


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert w.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0
