"""Whitening against the eigenvalues of the whole covariance."""

import math

import numpy as np
import pytest

from indexwright.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>, deviation string, row int"


def _whole(vectors):
    return np.floor(np.array(vectors, np.float32).astype(float) * 1024).astype(np.int64) + 100_000


def _check(made, keys, vectors, most=8):
    x = _whole(vectors)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    covariance = centred.T @ centred / n
    values = np.sort(np.linalg.eigvalsh(covariance))[::-1][:most]
    rows = {r["vec_id"]: r for r in made.frame.collect()}
    assert made.n == n and set(rows) == set(keys)
    assert np.allclose(made.explained, values / np.trace(covariance), rtol=1e-9)
    assert made.identity_error < 1e-9
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums)) for row in x]
    assert [rows[k]["deviation"] for k in keys] == deviation
    out = np.array([rows[k]["whitened"] for k in keys])
    axes = np.array(made.components)
    assert np.allclose(covariance @ axes.T, axes.T * values, atol=1e-9 * values[0])
    assert np.allclose(out, centred @ axes.T / np.sqrt(values), atol=1e-9)


def test_whitening(spark):
    rng = np.random.default_rng(4)
    vectors = (rng.normal(size=(300, 12)) * np.linspace(0.1, 2, 12)).astype(np.float32).tolist()
    vectors += [vectors[0]] * 150  # a third of all rows are one vector
    good = [(i, v, "x", 3) for i, v in enumerate(vectors)]
    bad = [(900, None, "x", 1), (901, [], None, 1), (902, [1.0] * 11 + [None], "x", 1), (903, [math.nan] * 12, "x", 1), (904, [math.inf] * 12, "x", 1),
           (905, [1.0, 2.0], "x", 1), (906, [3e38] * 12, "x", 1)]
    made = whitening.whiten(spark.createDataFrame(good + bad, SCHEMA).repartition(5))
    assert made.frame.columns == ["vec_id", "row", "deviation", "whitened"]
    _check(made, list(range(len(vectors))), vectors)


def test_equal_variances_and_few_dimensions(spark):
    square = [[a, b, 0.0] for a in (-1.0, 1.0) for b in (-1.0, 1.0)]
    made = whitening.whiten(spark.createDataFrame([(i, v, None, None) for i, v in enumerate(square)], SCHEMA))
    _check(made, [0, 1, 2, 3], square, most=2)  # the third dimension has no variance


@pytest.mark.parametrize("data", [[], [(1, None, None, None)], [(1, [1.0, 2.0], None, None)], [(1, [1.0, 2.0], None, None)] * 3])
def test_nothing_to_whiten(spark, data):
    made = whitening.whiten(spark.createDataFrame(data, SCHEMA))
    assert made.explained == [] and made.identity_error is None
    assert made.frame.count() == sum(r[1] is not None for r in data)


def test_a_distance_no_long_holds_is_null(spark):
    made = whitening.whiten(spark.createDataFrame([(1, [4e9, 0.0], None, None), (2, [-4e9, 1.0], None, None)], "vec_id bigint, embedding array<double>, a string, b int"))
    assert [r["deviation"] for r in made.frame.collect()] == [None, None]


@pytest.mark.parametrize("size", [1, 2, 3, 9, 40])
def test_solver(size):
    rng = np.random.default_rng(size)
    turn, _ = np.linalg.qr(rng.normal(size=(size, size)))
    for spread in (rng.uniform(0, 9, size), np.ones(size), np.where(np.arange(size) < 3, 5.0, 1e-6), np.where(np.arange(size) < 2, 2.0, 0.0)):
        matrix = (turn * spread) @ turn.T
        matrix = (matrix + matrix.T) / 2
        values, axes = whitening.leading_components(matrix)
        want = np.sort(np.linalg.eigvalsh(matrix))[::-1][:8]
        assert np.allclose(values, want[:len(values)], atol=1e-12 * want[0]) and (want[len(values):] < 1e-11 * want[0]).all()
        assert np.allclose(matrix @ axes.T, axes.T * values, atol=1e-11 * want[0]) and np.allclose(axes @ axes.T, np.eye(len(values)), atol=1e-11)


def test_query(spark):
    got = queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001")
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert got.count() == 8 * vectors and got.agg({"identity_error": "max"}).first()[0] < 1e-9
