"""Linear algebra: products as joins of dense blocks; tall matrices are factorized by the QR factors of their blocks of rows, square
and wide ones on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ndarray import NDArray

#: Fixed value: what counts as zero in factorizations.
TOLERANCE = 1e-10
#: Rows or columns up to which a matrix (of a tall one, its columns) is factorized on the driver; more raise an error.
DENSE = 4096
#: Numbers in a block of rows that one task factorizes, and how many such factors meet in one.
BLOCK_NUMBERS, FAN_IN = 1 << 20, 64


def cells(a: NDArray) -> DataFrame:
    """(i, j, v) of a matrix."""
    c = a.shape[1]
    return a.df.select(F.floor(F.col("idx") / c).alias("i"), (F.col("idx") % c).alias("j"), F.col("value").alias("v"))


def _dense(a: NDArray) -> np.ndarray:
    if max(a.shape, default=0) > DENSE:
        raise ValueError(f"only matrices of at most {DENSE} rows and columns are factorized on the driver")
    return a.to_numpy()


def _square(a: NDArray) -> None:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        raise ValueError("the matrix must be square")


def dot(a: NDArray, b: NDArray) -> NDArray:
    """Vectors and matrices in all four ways; a vector product has shape [1]."""
    if a.shape[-1] != b.shape[0] or a.ndim > 2 or b.ndim > 2:
        raise ValueError(f"shapes {a.shape} and {b.shape} can't be multiplied")
    left = a.reshape([1, a.size]) if a.ndim == 1 else a
    right = b.reshape([b.size, 1]) if b.ndim == 1 else b
    shape = [*a.shape[:-1], *b.shape[1:]]
    return matmul(left, right).reshape(shape or [1])


def _tiles(a: NDArray, rows: int, columns: int, names: tuple[str, str, str]) -> DataFrame:
    """A row for each tile of ``rows`` x ``columns``: its row and column number and its cells."""
    at = lambda c, n: F.floor(F.col(c) / n)
    made = cells(a).groupBy(at("i", rows).alias(names[0]), at("j", columns).alias(names[1]))
    return made.agg(F.collect_list(F.struct((F.col("i") % rows * columns + F.col("j") % columns).alias("at"), "v")).alias(names[2]))


def _dense_tile(column: pa.Array, k: int, shape: tuple[int, int]) -> np.ndarray:
    some = column.slice(k, 1).flatten()
    out = np.zeros(shape[0] * shape[1])
    out[some.field("at").to_numpy()] = some.field("v").to_numpy()
    return out.reshape(shape)


def matmul(a: NDArray, b: NDArray, block: int = 256) -> NDArray:
    """Tile by tile: tiles of the inner index are joined, multiplied in NumPy and added up place by place."""
    (m, k), (k2, n) = a.shape, b.shape
    if k != k2:
        raise ValueError("inner sizes differ")
    tm, tk, tn = (max(1, min(block, x)) for x in (m, k, n))

    def multiply(batches):
        for rows in batches:
            for r in range(rows.num_rows):
                p = _dense_tile(rows.column("a"), r, (tm, tk)) @ _dense_tile(rows.column("b"), r, (tk, tn))
                i0, j0 = rows.column("bi")[r].as_py() * tm, rows.column("bj")[r].as_py() * tn
                p = p[: m - i0, : n - j0]
                at = (np.arange(i0, i0 + p.shape[0])[:, None] * n + np.arange(j0, j0 + p.shape[1])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(p.ravel())], ["idx", "value"])

    pairs = _tiles(a, tm, tk, ("bi", "bk", "a")).join(_tiles(b, tk, tn, ("bk", "bj", "b")), "bk")
    part = pairs.mapInArrow(multiply, "idx long, value double")
    if k > tk:
        part = part.groupBy("idx").agg(F.sum("value").alias("value"))
    return NDArray(part, [m, n])


def matmul_blocked(a: NDArray, b: NDArray, block: int = 64) -> NDArray:
    """The same with the size of the tiles to choose."""
    return matmul(a, b, block)


def trace(a: NDArray) -> float:
    found = cells(a).filter(F.col("i") == F.col("j")).agg(F.coalesce(F.sum("v"), F.lit(0.0)))
    return found.first()[0]


def norm(a: NDArray) -> float:
    return a.df.agg(F.sqrt(F.coalesce(F.sum(F.col("value") * F.col("value")), F.lit(0.0)))).first()[0]


def is_symmetric(a: NDArray, tolerance: float = TOLERANCE) -> bool:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        return False
    return _furthest(a, a.transpose()) <= tolerance


def is_orthogonal(a: NDArray, tolerance: float = TOLERANCE) -> bool:
    if a.ndim != 2 or a.shape[0] != a.shape[1]:
        return False
    n = a.shape[0]
    one = NDArray(a.df.sparkSession.range(n * n).select(F.col("id").alias("idx"), F.when(F.col("id") % (n + 1) == 0, 1.0).otherwise(0.0).alias("value")), [n, n])
    return _furthest(matmul(a, a.transpose()), one) <= tolerance


def _furthest(a: NDArray, b: NDArray) -> float:
    joined = a.df.join(b.df.withColumnRenamed("value", "other"), "idx")
    return joined.agg(F.coalesce(F.max(F.abs(F.col("value") - F.col("other"))), F.lit(0.0))).first()[0]


def det(a: NDArray) -> float:
    _square(a)
    return float(np.linalg.det(_dense(a)))


def inv(a: NDArray) -> NDArray | None:
    """None if the determinant is under the tolerance."""
    _square(a)
    m = _dense(a)
    return None if abs(np.linalg.det(m)) < TOLERANCE else NDArray.from_numpy(a.df.sparkSession, np.linalg.inv(m))


def _r_factor(a: NDArray, also: NDArray | None = None) -> np.ndarray:
    """R of a tall matrix (and of further columns beside it), without Q.

    A task factorizes a block of rows; of the factors, at most n x n each, FAN_IN at a time are stacked and factorized again
    until one is left. This keeps what squares of numbers would lose: R is as exact as the matrix.
    """
    m, n = a.shape
    if n > DENSE:
        raise ValueError(f"only matrices of at most {DENSE} columns are factorized")
    part = lambda x, w, first: x.df.select(F.floor(F.col("idx") / w).alias("i"), (F.col("idx") % w + first).alias("j"), "value")
    table, width = part(a, n, 0), n
    if also is not None:
        width = n + also.size // m
        table = table.unionByName(part(also, width - n, n))
    rows = max(width, BLOCK_NUMBERS // width)
    key = F.floor(F.col("i") / rows)
    blocks = table.groupBy(key.alias("block")).agg(F.collect_list(F.struct((F.col("i") % rows * width + F.col("j")).alias("at"), F.col("value").alias("v"))).alias("cells"))

    def first(batches):
        for b in batches:
            for k in range(b.num_rows):
                number = b.column("block")[k].as_py()
                r = np.linalg.qr(_dense_tile(b.column("cells"), k, (min(rows, m - number * rows), width)), mode="r")
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([r.tobytes()], pa.binary())], ["block", "r"])

    def again(batches):
        for b in batches:
            for number, parts in zip(b.column("block").to_pylist(), b.column("parts").to_pylist(), strict=True):
                r = np.linalg.qr(np.concatenate([np.frombuffer(x).reshape(-1, width) for x in parts]), mode="r")
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([r.tobytes()], pa.binary())], ["block", "r"])

    level, many = blocks.mapInArrow(first, "block long, r binary"), -(-m // rows)
    while many > 1:
        stacked = level.groupBy(F.floor(F.col("block") / FAN_IN).alias("block")).agg(F.array_sort(F.collect_list("r")).alias("parts"))
        level, many = stacked.mapInArrow(again, "block long, r binary"), -(-many // FAN_IN)
    found = level.first()
    return np.frombuffer(bytes(found["r"])).reshape(-1, width) if found else np.zeros((0, width))


def _independent(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R without the rows of columns that depend on earlier ones (these are zero), no negative diagonal, and the other columns' numbers."""
    n = r.shape[1]
    q, out = np.zeros((r.shape[0], n)), np.zeros((n, n))
    for j in range(n):
        x = r[:, j].copy()
        for _ in (0, 1):
            c = q.T @ x
            x -= q @ c
            out[:, j] += c
        out[j, j] = np.linalg.norm(x)
        if out[j, j] > TOLERANCE:
            q[:, j] = x / out[j, j]
        else:
            out[j, j] = 0.0
    return out, np.flatnonzero(np.diag(out) > 0)


def _qr(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reduced factors on the driver: columns that depend on earlier ones have no column in Q (zeros) and no row in R."""
    k = min(m.shape)
    r, own = _independent(m)
    q = np.zeros((m.shape[0], m.shape[1]))
    q[:, own] = np.linalg.solve(r[np.ix_(own, own)].T, m[:, own].T).T
    # once more, for columns that are nearly dependent
    r2, _ = _independent(q)
    q[:, own] = np.linalg.solve(r2[np.ix_(own, own)].T, q[:, own].T).T
    r = r2 @ r
    if m.shape[0] < m.shape[1]:
        keep = own[:k] if len(own) >= k else np.arange(k)
        return q[:, keep], r[keep]
    return q, r


def qr(a: NDArray) -> tuple[NDArray, NDArray]:
    """Reduced factors; R has no negative diagonal, dependent columns are zero in Q and have no row in R.

    Of a tall matrix, Q is A times the inverse of R (of independent columns), twice, so that it is orthogonal.
    """
    spark, (m, n) = a.df.sparkSession, a.shape
    if m <= n:
        return tuple(NDArray.from_numpy(spark, x) for x in _qr(_dense(a)))
    q, r = a, np.eye(n)
    for _ in (0, 1):
        step, own = _independent(_r_factor(q))
        inverse = np.zeros((n, n))
        inverse[np.ix_(own, own)] = np.linalg.inv(step[np.ix_(own, own)])
        q, r = matmul(q, NDArray.from_numpy(spark, inverse)), step @ r
    return q, NDArray.from_numpy(spark, r)


def solve(a: NDArray, b: NDArray) -> NDArray | None:
    """x with a x = b by QR; None if columns of a depend on each other. A tall system's x has the least squares: R of a and b
    side by side holds all that it takes."""
    spark, (m, n) = a.df.sparkSession, a.shape
    if m > n:
        both = _r_factor(a, b)
        r, right = both[:n, :n], both[:n, n:]
    else:
        q, r = np.linalg.qr(_dense(a))
        right = (q.T @ b.to_numpy()).reshape(len(r), -1)
    if m < n or len(_independent(r)[1]) < n:
        return None
    return NDArray.from_numpy(spark, np.linalg.solve(r, right).reshape([n, *b.shape[1:]]))


def eig(a: NDArray) -> tuple[NDArray, NDArray] | None:
    """Eigenvalues in descending order and unit eigenvectors as columns; None if any is complex."""
    _square(a)
    values, vectors = np.linalg.eig(_dense(a))
    if np.any(np.abs(values.imag) > TOLERANCE):
        return None
    order = np.argsort(-values.real, kind="stable")
    return tuple(NDArray.from_numpy(a.df.sparkSession, x) for x in (values.real[order], vectors.real[:, order]))


def svd(a: NDArray) -> tuple[NDArray, NDArray, NDArray]:
    """U, singular values, V transposed, so that their product is the matrix. Of tall matrices: those of R, and U = A V / s."""
    spark, (m, n) = a.df.sparkSession, a.shape
    if m <= n:
        return tuple(NDArray.from_numpy(spark, x) for x in np.linalg.svd(_dense(a), full_matrices=False))
    _, s, vt = np.linalg.svd(_r_factor(a), full_matrices=False)
    scaled = vt.T / np.where(s > TOLERANCE, s, np.inf)
    return matmul(a, NDArray.from_numpy(spark, scaled)), NDArray.from_numpy(spark, s), NDArray.from_numpy(spark, vt)


def rank(a: NDArray, tolerance: float = TOLERANCE) -> int:
    """Singular values above ``tolerance``, or above what rounding alone makes of the largest."""
    small = _dense(a) if a.shape[0] <= a.shape[1] else _r_factor(a)
    s = np.linalg.svd(small, compute_uv=False)
    return int((s > max(tolerance, (s.max() if len(s) else 0.0) * max(a.shape) * np.finfo(float).eps)).sum())


def conv2d(image: NDArray, kernel: NDArray, tile: int = 256) -> NDArray:
    """Cross-correlation, stride 1, no padding. The result is cut into tiles; a cell goes to the few tiles whose places read it,
    and each tile is computed in NumPy."""
    (h, w), weights = image.shape, _dense(kernel)
    kh, kw = weights.shape
    oh, ow = h - kh + 1, w - kw + 1
    if oh < 1 or ow < 1:
        raise ValueError("the kernel is larger than the image")
    th, tw = min(tile, oh), min(tile, ow)
    spans = lambda c, k, t, o: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - (k - 1), F.lit(0)) / t), F.floor(F.least(F.col(c), F.lit(o - 1)) / t)))
    spread = cells(image).select("i", "j", "v", spans("i", kh, th, oh).alias("ti")).select("i", "j", "v", "ti", spans("j", kw, tw, ow).alias("tj"))
    shape = th + kh - 1, tw + kw - 1
    place = ((F.col("i") - F.col("ti") * th) * shape[1] + F.col("j") - F.col("tj") * tw).alias("at")
    tiles = spread.groupBy("ti", "tj").agg(F.collect_list(F.struct(place, "v")).alias("cells"))

    def convolve(batches):
        for b in batches:
            for k in range(b.num_rows):
                x = _dense_tile(b.column("cells"), k, shape)
                i0, j0 = b.column("ti")[k].as_py() * th, b.column("tj")[k].as_py() * tw
                out = sum(weights[i, j] * x[i : i + th, j : j + tw] for i in range(kh) for j in range(kw))[: oh - i0, : ow - j0]
                at = (np.arange(i0, i0 + out.shape[0])[:, None] * ow + np.arange(j0, j0 + out.shape[1])).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out.ravel())], ["idx", "value"])

    return NDArray(tiles.mapInArrow(convolve, "idx long, value double"), [oh, ow])
