import math
from fractions import Fraction

import numpy as np
import pytest

from riskframe.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, vectors, parts=3):
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], 1) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def plain(vectors):
    """Whole numbers, exact mean and deviations, eigenvalues and whitened values (up to sign) by dense algebra."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(Fraction(c) - Fraction(s, n)) for c, s in zip(row, sums)] for row in x])
    u, sigma, vt = np.linalg.svd(centred, full_matrices=False)
    return n, deviation, sigma**2 / n, u * math.sqrt(n)


def spread_vectors(n=200, d=12, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * np.linspace(2, 0.01, d) + 5


def test_as_dense_algebra(spark):
    vectors = spread_vectors()
    n, deviation, values, white = plain(vectors)
    got = {}
    for r in wh.by_component(wh.whiten(table(spark, vectors))).collect():
        got[r["vec_id"], r["component"]] = r
    assert len(got) == len(vectors) * 8
    for k in range(1, 9):
        ours = np.array([got[i, k]["whitened"] for i in range(n)])
        sign = np.sign(ours @ white[:, k - 1])
        assert np.abs(ours * sign - white[:, k - 1]).max() < 1e-8
        assert abs(got[0, k]["explained"] / (values[k - 1] / values.sum()) - 1) < 1e-9
    assert [got[i, 1]["deviation"] for i in range(n)] == deviation
    assert got[0, 1]["n"] == n and got[0, 1]["identity_error"] < 1e-9


def test_unusable_rows_and_clashing_columns(spark):
    good = spread_vectors(40, 5).tolist()
    bad = [None, [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 1, 2, 3, 4], [], [1.0, 2.0], [None] * 5]
    df = table(spark, good + bad).selectExpr("*", "1 AS n", "2 AS w", "3 AS v", "4 AS id", "5 AS explained")
    got = wh.whiten(df)
    assert got.columns == ["vec_id", "n", "deviation", "w", "explained", "identity_error"]
    rows = got.collect()
    assert sorted(r["vec_id"] for r in rows) == list(range(40)) and all(len(r["w"]) == 5 for r in rows)
    assert {r["n"] for r in rows} == {40}


def test_components_without_variance(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(50, 2)) @ rng.integers(-3, 4, size=(2, 6)) * 8
    flat = np.round(flat * 1024) / 1024
    flat[:, 4:] = 7.0
    rows = wh.by_component(wh.whiten(table(spark, flat))).collect()
    rank = int((plain(flat)[2] > 1e-9).sum())
    assert {r["component"] for r in rows} == set(range(1, 7))
    assert all((r["whitened"] is None) == (r["component"] > rank) for r in rows)
    assert all(r["identity_error"] < 1e-6 for r in rows)


def test_one_row_and_copies(spark):
    one = wh.by_component(wh.whiten(table(spark, [[1.0, 2.0]]))).collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    vectors = spread_vectors(30, 4).tolist() * 3
    rows = wh.whiten(table(spark, vectors)).collect()
    by = {r["vec_id"]: tuple(r["w"]) for r in rows}
    assert all(by[i] == by[i + 30] == by[i + 60] for i in range(30))


@pytest.mark.parametrize("vectors", [[], [None, []]])
def test_nothing_usable(spark, vectors):
    assert wh.by_component(wh.whiten(table(spark, vectors, 1))).collect() == []


def test_partitions_change_nothing_but_rounding(spark):
    vectors = spread_vectors(120, 9)
    one = {r["vec_id"]: r["w"] for r in wh.whiten(table(spark, vectors, 1)).collect()}
    many = {r["vec_id"]: r["w"] for r in wh.whiten(table(spark, vectors, 40)).collect()}
    assert max(np.abs(np.array(one[i]) - many[i]).max() for i in one) < 1e-9


def test_deviations_stay_exact_or_are_null():
    x = np.array([[100_000 + 2**20, 100_000 - 2**20], [100_000, 100_000 + 3]])
    n, sums = 10**9 + 7, [100_000 * (10**9 + 7) + 11, 100_000 * (10**9 + 7) - 5]
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    assert exact[0] >= 2**63 and wh.Centre(n, sums).deviations(x) == [None, None if exact[1] >= 2**63 else exact[1]]
    assert wh.Centre(1000, [100_000_011, 99_999_995]).deviations(x)[0] == sum(
        (1000 * int(c) - s) ** 2 for c, s in zip(x[0], [100_000_011, 99_999_995])
    )


@pytest.mark.parametrize("n", [1, 2, 5, 33])
def test_qd_values_and_twisted_vectors(n):
    rng = np.random.default_rng(n)
    d, e = rng.normal(size=n) * np.logspace(0, -12, n), rng.normal(size=max(n - 1, 0)) * 1e-3
    b = np.diag(d) + (np.diag(e, 1) if n > 1 else 0)
    assert np.allclose(wh.dqds(d, e), np.linalg.svd(b, compute_uv=False), rtol=1e-9, atol=1e-300 if n < 5 else 1e-16)
    r = np.triu(rng.normal(size=(n, n)))
    values, vectors = wh.principal(r, n)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-10)
    assert np.allclose(r.T @ (r @ vectors), vectors * values[: vectors.shape[1]] ** 2, atol=1e-12 * values[0] ** 2)


@pytest.mark.parametrize("matrix", [np.eye(6) * 3, np.diag([2.0, 2.0, 1.0, 0.0, 0.0]), np.kron(np.eye(3), np.triu(np.ones((3, 3))))])
def test_equal_values_get_orthogonal_vectors(matrix):
    values, vectors = wh.principal(matrix, len(matrix))
    assert np.allclose(values, np.linalg.svd(matrix, compute_uv=False), atol=1e-14)
    assert np.allclose(vectors.T @ vectors, np.eye(vectors.shape[1]), atol=1e-12)
    assert np.allclose(matrix.T @ (matrix @ vectors), vectors * values[: vectors.shape[1]] ** 2, atol=1e-12)
