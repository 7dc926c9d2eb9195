import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from autoprofile.llm import whitening
from autoprofile.llm.whitening import (
    BLOCK_ROWS, Centre, WhitenRules, largest_eigenpairs, minres, whiten,
)

SCHEMA = "vec_id long, embedding array<float>"


def vectors(count, dimensions, seed=1):
    random = np.random.default_rng(seed)
    spread = np.linspace(0.05, 0.6, dimensions)
    return (random.standard_normal((count, dimensions)) * spread).astype(np.float32)


def expected(rows, most=8):
    """(key, component) -> n, deviation, |whitened|, explained by a dense eigensolver."""
    whole = [
        (k, [math.floor(1024 * float(c)) + 100_000 for c in v]) for k, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    size = max(len(x) for _, x in whole)
    whole = [(k, x) for k, x in whole if len(x) == size]
    n = len(whole)
    sums = [sum(x[d] for _, x in whole) for d in range(size)]
    centred = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for _, x in whole])
    covariance = centred.T @ centred / n
    values, own = np.linalg.eigh(covariance)
    values, own = values[::-1][:most], own[:, ::-1][:, :most]
    white = np.abs(centred @ own) / np.sqrt(values)
    out = {}
    for (key, x), w in zip(whole, white):
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for j in range(len(values)):
            out[key, j + 1] = (n, deviation, w[j], values[j] / np.trace(covariance))
    return out


def check(df, rows):
    got = whiten(df).collect()
    right = expected(rows)
    assert len(got) == len(right)
    for row in got:
        n, deviation, white, explained = right[row["vec_id"], row["component"]]
        assert (row["n"], row["deviation"]) == (n, deviation)
        assert abs(row["whitened"]) == pytest.approx(white, rel=1e-7, abs=1e-7)
        assert row["explained"] == pytest.approx(explained, rel=1e-10)
        assert row["identity_error"] < 1e-10
    one = {r["identity_error"] for r in got}
    assert len(one) == 1
    return got


def test_against_a_dense_solver(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(400, 24))]
    df = spark.createDataFrame(rows, SCHEMA)
    one = check(df.withColumns({"id": F.lit("x"), "component": F.lit(1)}), rows)
    other = check(df.repartition(7), rows)
    signs = {(r["vec_id"], r["component"]): r["whitened"] for r in one}
    for r in other:  # the same side for all rows, whatever their order
        assert r["whitened"] == pytest.approx(signs[r["vec_id"], r["component"]], abs=1e-7)


def test_many_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DIRECT_PARTS", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 16)
    assert BLOCK_ROWS == 1024
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(300, 12, 3))]
    check(spark.createDataFrame(rows, SCHEMA).repartition(5), rows)


ODD = [
    (0, None), (1, []), (2, [1.0, None, 2.0]), (3, [math.nan, 1.0, 2.0]),
    (4, [math.inf, 0.0, 0.0]), (5, [1.0, 2.0]), (6, [0.5, 0.25, 0.1]), (7, [0.1, -0.2, 0.9]),
    (8, [-0.5, 0.75, 0.3]), (9, [-20.0, 3.0, 7.0]), (10, [0.5, 0.25, 0.11]),
]


def test_odd_rows(spark):
    check(spark.createDataFrame(ODD, SCHEMA), ODD)


def test_null_and_repeated_keys(spark):
    rows = [(None, [0.1, 0.2]), (None, [0.4, -0.2]), (1, [0.9, 0.2]), (1, [0.9, 0.2])]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1"] * 4 + ["None"] * 4


def test_without_variance(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, []), (2, None)], SCHEMA)).collect() == []
    same = [(i, [0.5, 0.25]) for i in range(4)]
    assert whiten(spark.createDataFrame(same, SCHEMA)).collect() == []
    line = [(i, [i / 8, i / 8, 1.0]) for i in range(5)]  # one direction only
    got = whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert [r["component"] for r in got] == [1] * 5
    assert all(r["explained"] == pytest.approx(1.0) for r in got)


def test_far_numbers_are_exact(spark):
    """Where squares pass 64 bits they are taken exactly, and are null beyond a long."""
    rows = [(i, [float(2 ** (20 + i)), 0.0]) for i in range(4)]
    right = expected(rows)
    got = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in got:
        assert r["deviation"] == right[r["vec_id"], 1][1]
    huge = [(0, [3e38, 0.0]), (1, [-3e38, 1.0])]
    got = whiten(spark.createDataFrame(huge, SCHEMA)).collect()
    assert [r["deviation"] for r in got if r["component"] == 1] == [None, None]


@pytest.mark.parametrize("dimensions", [1, 3, 8, 40, 300])
def test_eigenpairs(dimensions):
    data = vectors(3 * dimensions + 5, dimensions, dimensions).astype(float)
    matrix = data.T @ data
    values, own = largest_eigenpairs(lambda v: matrix @ v, dimensions, WhitenRules())
    dense = np.linalg.eigvalsh(matrix)[::-1][: len(values)]
    assert np.allclose(values, dense, rtol=1e-12, atol=0)
    assert np.abs(own.T @ own - np.eye(len(values))).max() < 1e-13
    assert np.linalg.norm(matrix @ own - own * values, axis=0).max() < 1e-12 * values[0]


def test_equal_eigenvalues():
    diagonal = np.array([3.0] * 3 + [2.0] * 7 + [1.0] * 3 + [0.0] * 30)
    values, _ = largest_eigenpairs(lambda v: diagonal[:, None] * v, 43, WhitenRules())
    assert np.allclose(values, [3] * 3 + [2] * 5)


def test_minres_solves_indefinite_systems():
    random = np.random.default_rng(5)
    own = np.linalg.qr(random.standard_normal((30, 30)))[0]
    matrix = own * np.r_[np.linspace(-4, -1, 12), np.linspace(1, 9, 18)] @ own.T
    right = random.standard_normal((30, 4))
    right[:, 2] = 0
    found = minres(lambda v: matrix @ v, right, 40)
    assert np.abs(matrix @ found - right).max() < 1e-8


def test_centre():
    centre = Centre(3, (10, -7))
    x = np.array([[4, -2], [3, -2], [3, -3]])
    assert np.allclose(centre.centred(x), x - np.array([10 / 3, -7 / 3]))
    assert centre.deviations(x) == [(12 - 10) ** 2 + 1, 1 + 1, 1 + 4]
