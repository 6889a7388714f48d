from __future__ import annotations

import math

import numpy as np
import pytest

from ebbtide.llm import whitening
from ebbtide.llm.queries import op11_whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, x string, block string"


def slow_whitening(ids, vectors, components=8):
    x = np.floor(1024 * np.asarray(vectors, np.float64)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    deviation = [sum(int(v) ** 2 for v in row) for row in n * x - sums]
    return n, dict(zip(ids, deviation, strict=True)), values, axes, centred @ axes / np.sqrt(values), np.trace(centred.T @ centred) / n


def check(found, ids, vectors, components):
    n, deviation, values, _, whitened, trace = slow_whitening(ids, vectors, components)
    assert len(found) == len(ids) * components
    place = {v: i for i, v in enumerate(ids)}
    got = np.zeros((len(ids), components))
    for r in found:
        assert (r.n, int(r.deviation)) == (n, deviation[r.vec_id])
        assert math.isclose(r.explained, values[r.component - 1] / trace, rel_tol=1e-9)
        assert r.identity_error < 1e-8
        got[place[r.vec_id], r.component - 1] = r.whitened
    for c in range(components):
        sign = np.sign(got[:, c] @ whitened[:, c])
        assert np.abs(sign * got[:, c] - whitened[:, c]).max() < 1e-6


def test_query_against_eigenvectors(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    found = op11_whitening(spark, folder)
    assert dict(found.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double",
    }
    check(found.collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 8)


def product_of(x):
    return lambda part: part(x)


@pytest.mark.parametrize("shape", [(50, 6), (4, 9), (30, 1)])
def test_bidiagonalisation_gives_all_singular_values(shape):
    x = np.random.default_rng(3).standard_normal(shape)
    sigma, right, _ = whitening.bidiagonalise(product_of(x), shape[1], 8)
    expected = np.linalg.svd(x)[1]
    assert np.allclose(sigma[: len(expected)], expected, atol=1e-10) and np.allclose(sigma[len(expected) :], 0, atol=1e-10)
    assert np.allclose(right @ right.T, np.eye(len(right)), atol=1e-12)


def test_equal_deviations_are_all_found():
    """Krylov steps from one start meet one vector of each deviation; a new start has to find the others."""
    turn = np.linalg.qr(np.random.default_rng(5).standard_normal((40, 40)))[0][:, :6]
    x = turn * np.array([3.0, 3.0, 3.0, 2.0, 2.0, 1.0])
    sigma, right, _ = whitening.bidiagonalise(product_of(x), 6, 4)
    assert np.allclose(sigma, [3, 3, 3, 2, 2, 1])
    assert np.allclose(right.T @ np.diag(sigma**2) @ right, x.T @ x, atol=1e-10)


def test_steps_end_early_when_the_rest_is_small():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((500, 60)) * np.r_[[50.0, 40, 30, 20], np.full(56, 1e-3)]
    sigma, right, steps = whitening.bidiagonalise(product_of(x), 60, 3)
    assert steps < 30 and np.allclose(sigma[:3], np.linalg.svd(x)[1][:3], rtol=1e-12)


def test_awkward_vectors(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.standard_normal(5).astype(float).tolist(), 1, "i", "x", "b") for i in range(40)]
    rows = good + [
        (100, None, 1, "i", "x", "b"),
        (101, [], 1, "i", "x", "b"),
        (102, [1.0, None, 1.0, 1.0, 1.0], None, None, None, None),
        (103, [1.0, float("nan"), 1.0, 1.0, 1.0], 1, "i", "x", "b"),
        (104, [1.0, float("inf"), 1.0, 1.0, 1.0], 1, "i", "x", "b"),
        (105, [1.0, 2.0], 1, "i", "x", "b"),
        (None, [0.5] * 5, None, None, None, None),
        (3, good[3][1], 1, "i", "x", "b"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = whitening.whiten(df, components=8).collect()
    kept = good + rows[-2:]
    assert len(found) == len(kept) * 5  # five dimensions have five components
    n, deviation, *_ = slow_whitening(range(len(kept)), [np.float32(r[1]) for r in kept], 5)
    assert {r.n for r in found} == {n} and {int(r.deviation) for r in found} == set(deviation.values())
    assert sum(r.vec_id == 3 for r in found) == 10 and sum(r.vec_id is None for r in found) == 5
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 100")).count() == 0
    assert whitening.whiten(spark.createDataFrame([good[0]] * 9, SCHEMA)).count() == 0  # no variance


def test_dependent_columns_and_long_squares(spark):
    """A constant and a repeated column leave fewer components; squares beyond 64 bits stay exact."""
    rng = np.random.default_rng(4)
    base = rng.integers(-1000, 1000, (60, 3)).astype(float)
    vectors = np.column_stack([base, base[:, 0], np.ones(60)]) * 1000
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = whitening.whiten(df, components=5).collect()
    assert {r.component for r in found} == {1, 2, 3}
    _, deviation, *_ = slow_whitening(range(60), vectors, 3)
    assert {r.vec_id: int(r.deviation) for r in found} == deviation and max(deviation.values()) > 2**63
