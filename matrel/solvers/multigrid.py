"""Geometric multigrid over products: smoothing, restriction, coarse solve, prolongation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matrel.operators import products
from matrel.relation import Matrix
from matrel.solvers.operators import Csr, to_csr


def make_prolongation_1d(spark: SparkSession, coarse: int) -> Matrix:
    """From n to 2n + 1 points: weights 1 at the coarse point and 1/2 beside it."""
    rows = spark.range(coarse).select(F.col("id").alias("j"), F.explode(F.array(*[F.struct((2 * F.col("id") + k).alias("i"), F.lit(w).alias("v")) for k, w in ((0, 0.5), (1, 1.0), (2, 0.5))])).alias("x"))
    return Matrix(rows.select("x.i", "j", "x.v"), 2 * coarse + 1, coarse)


def make_restriction_1d(spark: SparkSession, fine: int) -> Matrix:
    """From n to (n - 1) / 2 points: 1/4, 1/2, 1/4."""
    n = (fine - 1) // 2
    rows = spark.range(n).select(F.col("id").alias("i"), F.explode(F.array(*[F.struct((2 * F.col("id") + k).alias("j"), F.lit(w).alias("v")) for k, w in ((0, 0.25), (1, 0.5), (2, 0.25))])).alias("x"))
    return Matrix(rows.select("i", "x.j", "x.v"), n, fine)


prolongate = restrict = products.mult


def galerkin(r: Matrix, a: Matrix, p: Matrix) -> Matrix:
    """The coarse operator ``R A P``."""
    return products.matmul(r, products.matmul(a, p))


class Multigrid:
    """``levels``: operators from fine to coarse; ``restrictions[k]`` and ``prolongations[k]`` link level k and k + 1.

    ``smoother(A) -> f(x, b)`` is made for each level, ``coarse(A) -> f(b)`` for the last.
    """

    def __init__(self, levels: list[Csr], restrictions: list[Csr], prolongations: list[Csr], smoother: Callable, coarse: Callable, pre: int = 2, post: int = 2):
        if len(levels) < 2:
            raise ValueError("at least two levels")
        self.levels, self.restrictions, self.prolongations = levels, restrictions, prolongations
        self.smooth = [smoother(a) for a in levels[:-1]]
        self.coarse = coarse(levels[-1])
        self.pre, self.post = pre, post

    @classmethod
    def from_relations(cls, levels: list[Matrix], restrictions: list[Matrix], prolongations: list[Matrix], smoother: Callable, coarse: Callable, **options) -> Multigrid:
        """From relations of a size that fits in memory."""
        return cls(*[[to_csr(m) for m in x] for x in (levels, restrictions, prolongations)], smoother, coarse, **options)

    def _cycle(self, x: np.ndarray, b: np.ndarray, k: int, visits: int) -> np.ndarray:
        if k == len(self.levels) - 1:
            return self.coarse(b)
        a = self.levels[k]
        for _ in range(self.pre):
            x = self.smooth[k](x, b)
        r = self.restrictions[k] @ (b - a @ x)
        e = np.zeros(len(r))
        for _ in range(visits if k + 2 < len(self.levels) else 1):
            e = self._cycle(e, r, k + 1, visits)
        x = x + self.prolongations[k] @ e
        for _ in range(self.post):
            x = self.smooth[k](x, b)
        return x

    def vcycle(self, x: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._cycle(x, b, 0, 1)

    def wcycle(self, x: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._cycle(x, b, 0, 2)

    def solve(self, b: np.ndarray) -> np.ndarray:
        """One V-cycle from zero: a preconditioner."""
        return self.vcycle(np.zeros(len(b)), b)

    adjoint_solve = solve
