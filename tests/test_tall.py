import numpy as np
import pytest
from pyspark.sql import functions as F

from contrast.operators import matrix
from contrast.plans import tall
from contrast.plans.settle import settle


def table(spark, data, parts=5):
    rows = [(f"s{i:05d}", [float(v) for v in row]) for i, row in enumerate(data)]
    return settle(spark.createDataFrame(rows, "sample_id string, features array<double>").repartition(parts), "test")


def plain(spark, data, parts=5):
    n = data.shape[1]
    return tall.Scaled(table(spark, data, parts), "features", np.zeros(n), np.ones(n))


def decaying(m, n, seed, values):
    rng = np.random.default_rng(seed)
    u, v = (np.linalg.qr(rng.normal(size=(size, len(values))))[0] for size in (m, n))
    return (u * values) @ v.T


def angle(a, b):
    """Sine of the largest principal angle."""
    return np.linalg.norm(a - b @ (b.T @ a), 2)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_r_factor_of_any_partitioning(spark, parts):
    data = np.random.default_rng(1).normal(size=(60, 9))
    r = tall.tall_r(plain(spark, data, parts))
    assert np.allclose(r.T @ r, data.T @ data)
    w = np.random.default_rng(2).normal(size=(9, 4))
    r = tall.tall_r(plain(spark, data, parts), w)
    assert np.allclose(r.T @ r, (data @ w).T @ (data @ w))
    assert np.allclose(tall.transposed(plain(spark, data, parts), w), data.T @ data @ w)


def test_condition_is_not_squared(spark):
    """A Gramian loses every singular value below 1e-8 of the largest."""
    values = np.logspace(0, -10, 6)
    data = decaying(300, 6, 3, values)
    sigma, right = tall.truncated_svd(plain(spark, data), 6)
    assert np.allclose(sigma, values, rtol=1e-4)
    _, _, vt = np.linalg.svd(data, full_matrices=False)
    assert all(angle(right[:, :i], vt[:i].T) < 1e-5 for i in range(1, 7))


@pytest.mark.parametrize("values", [np.logspace(2, -4, 120), 1 / np.arange(1, 301), np.r_[np.full(8, 5.0), np.full(290, 1.0)]])
def test_sketch_of_many_features(spark, values):
    data = decaying(400, 1200, 4, values)
    k = 8
    sigma, right = tall.truncated_svd(plain(spark, data), k)
    _, want, vt = np.linalg.svd(data, full_matrices=False)
    assert np.allclose(sigma, want[:k], rtol=1e-9)
    assert angle(right, vt[:k].T) < 1e-6
    assert np.allclose(right.T @ right, np.eye(k), atol=1e-10)


def test_noise_without_a_gap(spark):
    data = np.random.default_rng(6).normal(size=(500, 600))
    sigma, right = tall.truncated_svd(plain(spark, data), 10)
    _, want, vt = np.linalg.svd(data, full_matrices=False)
    assert np.allclose(sigma, want[:10], rtol=1e-8) and angle(right, vt[:10].T) < 1e-5


def test_rank_below_the_wanted(spark):
    data = decaying(50, 400, 5, np.array([3.0, 2.0]))
    sigma, right = tall.truncated_svd(plain(spark, data), 5)
    assert np.allclose(sigma, [3, 2]) and right.shape == (400, 2)
    nothing, none = tall.truncated_svd(plain(spark, np.zeros((4, 300))), 3)
    assert len(nothing) == 0 and none.shape == (300, 0)


def test_signs_are_fixed(spark):
    data = np.random.default_rng(8).normal(size=(80, 7))
    for parts in (1, 6):
        _, right = tall.truncated_svd(plain(spark, data, parts), 7)
        assert (right[np.abs(right).argmax(axis=0), np.arange(7)] > 0).all()
        _, flipped = tall.truncated_svd(plain(spark, -data, parts), 7)
        assert np.allclose(right, flipped)


def test_many_features_through_the_operator(spark):
    from pyspark.ml.functions import array_to_vector

    data = decaying(200, 700, 9, np.logspace(1, -2, 60)) + 3
    vectors = table(spark, data).withColumn("features", array_to_vector("features"))
    reduced, sigma = matrix.svd_features(vectors, 6)
    scaled = (data - data.mean(axis=0)) / data.std(axis=0, ddof=1)
    u, want, _ = np.linalg.svd(scaled, full_matrices=False)
    found = np.array([r.svd for r in reduced.orderBy("sample_id").collect()])
    assert np.allclose(sigma, want[:6]) and np.allclose(np.abs(found), np.abs(u[:, :6]), atol=1e-7)


def test_no_rows(spark):
    from pyspark.ml.functions import array_to_vector

    empty = table(spark, np.ones((2, 3))).where(F.lit(False)).withColumn("features", array_to_vector("features"))
    reduced, sigma = matrix.svd_features(empty, 2)
    assert sigma == [] and reduced.count() == 0
    assert matrix.svd_loadings(empty, 2).count() == 0
