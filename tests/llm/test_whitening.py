"""Whitening against numpy's eigenvectors, and the factors by themselves."""

import numpy as np
import pytest

from harvestline.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, x string, found int"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA).repartition(4)


def test_factors():
    rng = np.random.default_rng(0)
    for width, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (40, 40)):
        half = rng.normal(size=(width, rank)) * 10.0 ** -rng.integers(0, 4, rank)
        matrix = half @ half.T
        factor = w.pivoted_cholesky(matrix)
        assert factor.shape == (width, rank) and np.allclose(factor @ factor.T, matrix, rtol=0, atol=1e-12 * np.abs(matrix).max())
        turned = w.jacobi_columns(factor)
        values = np.sort((turned * turned).sum(0))[::-1]
        expected = np.linalg.eigvalsh(matrix)[::-1][:rank]
        assert np.allclose(values, expected, rtol=1e-6, atol=1e-14 * expected[0])
        unit = turned / np.sqrt((turned * turned).sum(0))
        assert np.abs(unit.T @ unit - np.eye(rank)).max() < 1e-12
    assert w.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_small_eigenvalues_keep_their_digits():
    """One-sided rotations find values of very different size to their own precision."""
    scale = np.diag(10.0 ** -np.arange(8))
    rng = np.random.default_rng(1)
    mixed = np.eye(8) + 0.1 * rng.normal(size=(8, 8))
    matrix = scale @ (mixed @ mixed.T) @ scale
    turned = w.jacobi_columns(w.pivoted_cholesky(matrix))
    product = np.prod((turned * turned).sum(0))
    assert np.isclose(product, np.linalg.det(mixed) ** 2 * 10.0 ** -56, rtol=1e-9)


def plain(vectors):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    distinct = np.unique(x, axis=0)
    n, total = len(distinct), distinct.sum(0)
    values, components = np.linalg.eigh(np.cov(distinct.T.astype(float), bias=True))
    values, components = values[::-1], components[:, ::-1]
    return n, ((n * x - total) ** 2).sum(1), (x - total / n) @ components / np.sqrt(np.abs(values)), values


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20))).astype(np.float32)
    vectors[100:200] = vectors[7]  # copies count once
    n, deviation, white, values = plain(vectors)
    rows = w.whitening_report(table(spark, vectors.tolist())).collect()
    assert len(rows) == 400 * 16 and {r["n"] for r in rows} == {n}
    found = np.zeros((400, 16))
    for r in rows:
        found[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == deviation[r["vec_id"]]
        assert abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-9
        assert r["identity_error"] < 1e-9
    sign = np.sign((found * white[:, :16]).sum(0))
    assert np.abs(found * sign - white[:, :16]).max() < 1e-8


def test_odd_vectors(spark):
    vectors = [
        [1.0, 2.0, 3.0], [1.0, 2.0, 3.0], [2.0, 2.0, 3.5], [0.0, 0.0, 0.0], [-1.0, 5.0, 2.0],
        None, [], [1.0], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0],
    ]
    frame = w.whiten(table(spark, vectors), output="found")
    assert frame.columns == ["vec_id", "embedding", "x", "found", "found_"]
    rows = {r["vec_id"]: r["found_"] for r in frame.collect()}
    assert len(rows) == len(vectors) and all(rows[i] is None for i in range(5, len(vectors)))
    n, deviation, white, _ = plain(vectors[:5])
    assert n == 4 and [rows[i]["deviation"] for i in range(5)] == deviation.tolist()
    assert all(len(rows[i]["whitened"]) == 3 for i in range(5)) and rows[0] == rows[1]
    got = np.array([rows[i]["whitened"] for i in range(5)])
    assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-9


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]] * 5])
def test_nothing_to_whiten(spark, vectors):
    frame = table(spark, vectors) if vectors else spark.createDataFrame([], SCHEMA)
    assert w.whitening_report(frame).count() == 0
    assert w.whiten(frame).count() == len(vectors)


def test_rank_and_large_entries(spark):
    """A covariance of rank one, entries of 2^50, and deviations beyond a long."""
    vectors = [[float(i), 2.0 * i, -float(i)] for i in range(9)]
    rows = w.whitening_report(table(spark, vectors)).collect()
    assert {r["component"] for r in rows} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in rows)
    large = [[2.0**50 * (i % 3), float(i)] for i in range(9)]
    rows = w.whitening_report(table(spark, large)).collect()
    assert len(rows) == 9  # the second value is lost beside the first, so the rank is one
    assert {r["deviation"] is None for r in rows} == {True, False}
