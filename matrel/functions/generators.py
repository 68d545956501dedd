"""Generators of ranges and test matrices: each is ``range`` and an expression of the indices."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from matrel.relation import Matrix, Vector, matrix


def _grid(spark: SparkSession, nrows: int, ncols: int, value: Column, where: Column | None = None) -> Matrix:
    cells = spark.range(nrows * ncols).select(F.expr(f"id div {max(1, ncols)}").alias("i"), (F.col("id") % max(1, ncols)).alias("j"))
    if where is not None:
        cells = cells.where(where)
    return Matrix(cells.select("i", "j", value.cast("double").alias("v")), nrows, ncols)


def _stencil(spark: SparkSession, n: int, entries: Sequence[tuple[Column, Column, Column]]) -> Matrix:
    """A few entries a row (column, value, whether it is there): one range and one explode."""
    made = F.array(*[F.when(ok, F.struct(col.cast("long").alias("j"), value.cast("double").alias("v"))) for col, value, ok in entries])
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x"))
    return Matrix(rows.select("i", "x.j", "x.v"), n, n)


def arange(spark: SparkSession, start: float, stop: float | None = None, step: float = 1) -> Vector:
    """From start (0 if only stop is given) up to, without, stop; a step of 0 or away from stop gives nothing."""
    if stop is None:
        start, stop = 0, start
    n = max(0, math.ceil((stop - start) / step)) if step else 0
    kind = "bigint" if all(isinstance(x, int) for x in (start, stop, step)) else "double"
    return Vector(spark.range(n).select(F.col("id").alias("i"), (F.lit(start) + F.col("id") * F.lit(step)).cast(kind).alias("v")), n)


def linspace(spark: SparkSession, start: float, stop: float, n: int = 50) -> Vector:
    """n equal steps; the last one is exactly stop."""
    step = (stop - start) / (n - 1) if n > 1 else 0.0
    value = F.when((F.col("id") == n - 1) & F.lit(n > 1), float(stop)).otherwise(F.lit(float(start)) + F.col("id") * F.lit(step))
    return Vector(spark.range(n).select(F.col("id").alias("i"), value.alias("v")), n)


def logspace(spark: SparkSession, start: float, stop: float, n: int = 50, base: float = 10.0) -> Vector:
    return linspace(spark, start, stop, n).map(lambda v: F.pow(F.lit(float(base)), v))


def geomspace(spark: SparkSession, start: float, stop: float, n: int = 50) -> Vector:
    """A geometric row with true ends; zero or mixed signs raise."""
    if start == 0 or stop == 0 or (start > 0) != (stop > 0):
        raise ValueError("both ends must be nonzero and of one sign")
    ratio = stop / start
    inner = F.lit(float(start)) * F.pow(F.lit(ratio), F.col("id") / F.lit(float(max(1, n - 1))))
    value = F.when(F.col("id") == 0, float(start)).when(F.col("id") == n - 1, float(stop)).otherwise(inner)
    return Vector(spark.range(n).select(F.col("id").alias("i"), value.alias("v")), n)


def hilbert(spark: SparkSession, m: int, n: int | None = None) -> Matrix:
    return _grid(spark, m, n or m, 1 / (F.col("i") + F.col("j") + 1))


def lotkin(spark: SparkSession, n: int) -> Matrix:
    return _grid(spark, n, n, F.when(F.col("i") == 0, 1.0).otherwise(1 / (F.col("i") + F.col("j") + 1)))


def lehmer(spark: SparkSession, n: int) -> Matrix:
    return _grid(spark, n, n, (F.least("i", "j") + 1) / (F.greatest("i", "j") + 1))


def minij(spark: SparkSession, n: int) -> Matrix:
    return _grid(spark, n, n, F.least("i", "j") + 1)


def frank(spark: SparkSession, n: int) -> Matrix:
    """Upper Hessenberg: ``n - max(i, j)`` from the subdiagonal up."""
    return _grid(spark, n, n, n - F.greatest("i", "j"), F.col("j") + 1 >= F.col("i"))


def moler(spark: SparkSession, n: int, alpha: float = -1.0) -> Matrix:
    off = F.least("i", "j") * F.lit(alpha * alpha) + F.lit(alpha)
    return _grid(spark, n, n, F.when(F.expr("i = j"), F.col("i") * F.lit(alpha * alpha) + 1).otherwise(off))


def pascal(spark: SparkSession, n: int) -> Matrix:
    """Binomials (i + j over i), as doubles; exact while they are below 2**53."""
    return matrix(spark, np.array([[float(math.comb(i + j, i)) for j in range(n)] for i in range(n)]))


def vandermonde(spark: SparkSession, x: Sequence[float]) -> Matrix:
    values = F.array(*[F.lit(float(v)) for v in x])
    return _grid(spark, len(x), len(x), F.pow(F.get(values, F.col("i").cast("int")), F.col("j").cast("double")))


def wilkinson(spark: SparkSession, n: int) -> Matrix:
    """Tridiagonal with ``|i - (n - 1) / 2|`` on the diagonal; n must be odd and at least 3."""
    if n < 3 or n % 2 == 0:
        raise ValueError("n must be odd and at least 3")
    i = F.col("id")
    return _stencil(spark, n, [(i - 1, F.lit(1.0), i > 0), (i, F.abs(i - n // 2), F.lit(True)), (i + 1, F.lit(1.0), i < n - 1)])


def clement(spark: SparkSession, n: int) -> Matrix:
    """Zero diagonal, ``sqrt((i + 1)(n - 1 - i))`` beside it, symmetric; eigenvalues n - 1, n - 3, ..."""
    i = F.col("id")
    return _stencil(spark, n, [(i - 1, F.sqrt(i * (n - i)), i > 0), (i + 1, F.sqrt((i + 1) * (n - 1 - i)), i < n - 1)])


def companion(spark: SparkSession, coefficients: Sequence[float]) -> Matrix:
    """Of the monic polynomial ``c0 + c1 x + ... + x^n``: ones below the diagonal, ``-c`` in the last column."""
    n = len(coefficients)
    a = np.zeros((n, n))
    a[np.arange(1, n), np.arange(n - 1)] = 1
    a[:, -1] = a[:, -1] - np.asarray(coefficients, float)
    return matrix(spark, a)


def forsythe(spark: SparkSession, n: int, alpha: float = 1e-10, value: float = 0.0) -> Matrix:
    """A Jordan block with ``alpha`` in the lower left corner."""
    i = F.col("id")
    corner = (F.lit(0), F.lit(float(alpha)), i == n - 1)
    return _stencil(spark, n, [corner, (i, F.lit(float(value)), F.lit(value != 0)), (i + 1, F.lit(1.0), i < n - 1)])


def kahan(spark: SparkSession, n: int, theta: float = 1.2, zeta: float = 25.0) -> Matrix:
    """Upper triangular: row i is ``sin(theta)^i`` times ``zeta`` on and ``-cos(theta)`` right of the diagonal."""
    s, c = math.sin(theta), math.cos(theta)
    power = F.pow(F.lit(s), F.col("i").cast("double"))
    return _grid(spark, n, n, F.when(F.expr("i = j"), power * F.lit(float(zeta))).otherwise(-c * power), F.expr("i <= j"))


def rosser(spark: SparkSession) -> Matrix:
    """The 8 x 8 matrix of Rosser with one double, three nearly equal and opposite eigenvalues."""
    # fixed values
    a = [
        [611, 196, -192, 407, -8, -52, -49, 29],
        [196, 899, 113, -192, -71, -43, -8, -44],
        [-192, 113, 899, 196, 61, 49, 8, 52],
        [407, -192, 196, 611, 8, 44, 59, -23],
        [-8, -71, 61, 8, 411, -599, 208, 208],
        [-52, -43, 49, 44, -599, 411, 208, 208],
        [-49, -8, 8, 59, 208, 208, 99, -911],
        [29, -44, 52, -23, 208, 208, -911, 99],
    ]
    return matrix(spark, np.array(a, float))


def magic(spark: SparkSession, n: int) -> Matrix:
    """A magic square: by steps along diagonals for odd n, by complements for multiples of 4; other n raise."""
    if n < 1 or n % 4 == 2:
        raise ValueError("n must be odd or a multiple of 4")
    i, j = F.col("i"), F.col("j")
    if n % 2:
        a, b = F.pmod(i + j + F.lit(2 - (n + 3) // 2), F.lit(n)), F.pmod(i + 2 * j + 1, F.lit(n))
        return _grid(spark, n, n, a * n + b + 1)
    natural = i * n + j + 1
    diagonal = (i % 4 == j % 4) | ((i % 4) + (j % 4) == 3)
    return _grid(spark, n, n, F.when(diagonal, n * n + 1 - natural).otherwise(natural))


def ones(spark: SparkSession, m: int, n: int | None = None) -> Matrix:
    return _grid(spark, m, n or m, F.lit(1.0))


def laplacian_1d(spark: SparkSession, n: int) -> Matrix:
    i = F.col("id")
    return _stencil(spark, n, [(i - 1, F.lit(-1.0), i > 0), (i, F.lit(2.0), F.lit(True)), (i + 1, F.lit(-1.0), i < n - 1)])


def laplacian_2d(spark: SparkSession, nx: int, ny: int, scale: float = 1.0) -> Matrix:
    """The five-point stencil; unknown (x, y) is row ``y nx + x``."""
    i = F.col("id")
    x, y = i % nx, F.expr(f"id div {nx}")
    side = F.lit(-scale)
    return _stencil(spark, nx * ny, [(i - nx, side, y > 0), (i - 1, side, x > 0), (i, F.lit(4.0 * scale), F.lit(True)), (i + 1, side, x < nx - 1), (i + nx, side, y < ny - 1)])


def poisson2d_dirichlet(spark: SparkSession, nx: int, ny: int) -> Matrix:
    """The five-point stencil over the unit square's inner points, by their distances: ``-u_xx - u_yy``."""
    cx, cy = float((nx + 1) ** 2), float((ny + 1) ** 2)
    i = F.col("id")
    x, y = i % nx, F.expr(f"id div {nx}")
    return _stencil(spark, nx * ny, [(i - nx, F.lit(-cy), y > 0), (i - 1, F.lit(-cx), x > 0), (i, F.lit(2 * cx + 2 * cy), F.lit(True)), (i + 1, F.lit(-cx), x < nx - 1), (i + nx, F.lit(-cy), y < ny - 1)])


def _orthogonal(m: int, n: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).uniform(-1, 1, (m, n)))
    return q * np.where(np.diag(r) < 0, -1, 1)


def randorth(spark: SparkSession, n: int, seed: int = 0) -> Matrix:
    return matrix(spark, _orthogonal(n, n, seed), keep_zeros=True)


def make_sigma(n: int, kappa: float, mode: int = 3, seed: int = 0) -> np.ndarray:
    """Singular values from 1 down to 1 / kappa. Mode 1: one large; 2: one small; 3: geometric; 4: arithmetic; 5: random in the logarithm."""
    low = 1 / kappa
    k = np.arange(n) / max(1, n - 1)
    if mode == 1:
        return np.where(np.arange(n) == 0, 1.0, low)
    if mode == 2:
        return np.where(np.arange(n) == n - 1, low, 1.0)
    if mode == 3:
        return low**k
    if mode == 4:
        return 1 - k * (1 - low)
    if mode == 5:
        out = np.exp(-np.random.default_rng(seed).uniform(0, 1, n) * math.log(kappa))
        out[0], out[-1] = 1.0, low if n > 1 else 1.0
        return out
    raise ValueError("mode must be 1 to 5")


def randsvd(spark: SparkSession, m: int, n: int | None = None, kappa: float = 10.0, mode: int = 3, sigma: Sequence[float] | None = None, seed: int = 0) -> Matrix:
    """``U S V^T`` with random orthogonal factors and the given or made singular values."""
    n = n or m
    r = min(m, n)
    s = make_sigma(r, kappa, mode, seed) if sigma is None else np.asarray(sigma, float)
    return matrix(spark, _orthogonal(m, r, seed) @ np.diag(s) @ _orthogonal(n, r, seed + 1).T, keep_zeros=True)


def randsym(spark: SparkSession, eigenvalues: Sequence[float], seed: int = 0) -> Matrix:
    """``Q L Q^T`` with the given eigenvalues."""
    q = _orthogonal(len(eigenvalues), len(eigenvalues), seed)
    a = q @ np.diag(np.asarray(eigenvalues, float)) @ q.T
    return matrix(spark, (a + a.T) / 2, keep_zeros=True)


def randspd(spark: SparkSession, n: int, kappa: float = 10.0, eigenvalues: Sequence[float] | None = None, seed: int = 0) -> Matrix:
    values = make_sigma(n, kappa, 3, seed) if eigenvalues is None else np.asarray(eigenvalues, float)
    if (np.asarray(values) <= 0).any():
        raise ValueError("eigenvalues must be positive")
    return randsym(spark, values, seed)
