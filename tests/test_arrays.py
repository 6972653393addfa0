import numpy as np
import pytest

from gridloom.operators import linalg
from gridloom.operators.ndarray import NDArray, broadcast_shapes, broadcastable, ravel, unravel


def arr(spark, values, shape=None):
    return NDArray.from_values(spark, values, shape)


def test_shape_and_index(spark):
    a = arr(spark, np.arange(24.0), [2, 3, 4])
    assert a[1, 2, 3] == 23 and a.reshape([6, 4]).shape == (6, 4) and a.ndim == 3 and len(a) == 24
    assert a.get([2, 0, 0]) is None and a.set([0, 0, 0], 9)[0, 0, 0] == 9
    assert ravel([1, 2, 3], [2, 3, 4]) == 23 and unravel(23, [2, 3, 4]) == [1, 2, 3]
    with pytest.raises(ValueError):
        a.reshape([5])
    with pytest.raises(ValueError):
        NDArray.from_values(spark, [1, 2, 3], [2])


def test_broadcast(spark):
    assert broadcast_shapes([1, 3], [2, 1]) == (2, 3) and not broadcastable([2], [3])
    got = (arr(spark, [[1, 2, 3]]) + arr(spark, [[10], [20]])).to_numpy()
    assert got.tolist() == [[11, 12, 13], [21, 22, 23]]
    assert (arr(spark, [[1, 2, 3], [4, 5, 6]]) + arr(spark, [[10, 20, 30]])).to_numpy().ravel().tolist() == [11, 22, 33, 14, 25, 36]
    assert arr(spark, [1, 2]).add_broadcast(arr(spark, [1, 2, 3])) is None
    with pytest.raises(ValueError):
        arr(spark, [1, 2]) + arr(spark, [1, 2, 3])
    assert (arr(spark, [1.0, -1.0, 0.0]) / 0).to_numpy()[:2].tolist() == [np.inf, -np.inf]


def test_reductions(spark):
    a = arr(spark, [[1, 2, 3], [4, 5, 6]])
    assert (a.sum(), a.mean(), a.max(), a.min()) == (21, 3.5, 6, 1)
    assert a.sum_axis(0).to_numpy().tolist() == [5, 7, 9] and a.mean_axis(1).to_numpy().tolist() == [2, 5]
    b = arr(spark, np.arange(24.0), [2, 3, 4])
    assert np.allclose(b.sum_axis(1).to_numpy(), np.arange(24.0).reshape(2, 3, 4).sum(axis=1))
    assert arr(spark, [1, 2]).sum_axis(0).shape == (1,)
    e = NDArray.zeros(spark, [0])
    assert np.isnan(e.mean()) and e.max() == -np.inf and e.min() == np.inf


def test_arange(spark):
    assert NDArray.arange(spark, 0, 1, 0.25).to_numpy().tolist() == [0, 0.25, 0.5, 0.75] and NDArray.arange(spark, 0, 3, -1).size == 0
    with pytest.raises(ValueError):
        NDArray.arange(spark, 0, 1, 0)


def test_products(spark):
    a, b = arr(spark, [[1, 2], [3, 4]]), arr(spark, [[5, 6], [7, 8]])
    assert linalg.dot(a, b).to_numpy().tolist() == [[19, 22], [43, 50]] == linalg.matmul_blocked(a, b, 1).to_numpy().tolist()
    assert linalg.dot(arr(spark, [1, 2, 3, 4]), arr(spark, [5, 6, 7, 8])).to_numpy().tolist() == [70]
    assert linalg.dot(a, arr(spark, [1, 1])).to_numpy().tolist() == [3, 7] and linalg.dot(arr(spark, [1, 1]), a).to_numpy().tolist() == [4, 6]
    assert a.transpose().to_numpy().tolist() == [[1, 3], [2, 4]]
    with pytest.raises(ValueError):
        linalg.dot(a, arr(spark, [1, 2, 3]))


def test_factorizations(spark):
    a = arr(spark, [[1, 2], [3, 4]])
    assert linalg.det(a) == pytest.approx(-2) and linalg.trace(a) == 5 and linalg.norm(a) == pytest.approx(30**0.5)
    assert np.allclose(linalg.inv(a).to_numpy() @ a.to_numpy(), np.eye(2)) and linalg.inv(arr(spark, [[1, 2], [2, 4]])) is None
    q, r = linalg.qr(a)
    assert np.allclose(q.to_numpy() @ r.to_numpy(), a.to_numpy()) and (np.diag(r.to_numpy()) >= 0).all() and linalg.is_orthogonal(q)
    values, vectors = linalg.eig(arr(spark, [[1, 0], [0, 3]]))
    assert values.to_numpy().tolist() == [3, 1] and abs(vectors.to_numpy()[1, 0]) == 1
    u, s, vt = (x.to_numpy() for x in linalg.svd(a))
    assert np.allclose((u * s) @ vt, a.to_numpy()) and linalg.rank(a) == 2
    assert not linalg.is_symmetric(a) and linalg.is_symmetric(arr(spark, [[1, 2], [2, 1]]))


def test_tall_paths_equal_dense_ones(spark, monkeypatch):
    m = np.random.default_rng(1).normal(size=(40, 4))
    a, b = arr(spark, m), arr(spark, m @ [1.0, 2.0, 3.0, 4.0])
    monkeypatch.setattr(linalg, "DENSE", 16)
    q, r = (x.to_numpy() for x in linalg.qr(a))
    assert np.allclose(q @ r, m) and np.allclose(q.T @ q, np.eye(4))
    u, s, vt = (x.to_numpy() for x in linalg.svd(a))
    assert np.allclose((u * s) @ vt, m) and np.allclose(linalg.solve(a, b).to_numpy().ravel(), [1, 2, 3, 4]) and linalg.rank(a) == 4


def test_conv2d(spark):
    image, kernel = np.arange(20.0).reshape(4, 5), np.array([[1.0, 2], [3, -1]])
    want = [[(image[i : i + 2, j : j + 2] * kernel).sum() for j in range(4)] for i in range(3)]
    assert np.allclose(linalg.conv2d(arr(spark, image), arr(spark, kernel)).to_numpy(), want)
