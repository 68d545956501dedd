"""Predicates of matrices and vectors: one-row frames ``value boolean``. NaN fails every comparison with a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.functions.scalar import abs_of
from matrel.operators import products, reductions
from matrel.operators.construct import identity
from matrel.operators.elementwise import conj, subtract
from matrel.operators.views import transposed
from matrel.relation import Matrix, Vector

EPS = 2.220446049250313e-16


def _lit(a: Matrix | Vector, value: bool) -> DataFrame:
    return a.df.sparkSession.range(1).select(F.lit(value).alias("value"))


def _all(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("value"))


def _small(v: Column, tol: float) -> Column:
    v = v.cast("double")
    return (v <= tol) & ~F.isnan(v)


def _magnitude(a: Matrix | Vector) -> Column:
    return abs_of(a.dtype)(F.col("v"))


def is_square(a: Matrix) -> DataFrame:
    return _lit(a, a.nrows == a.ncols)


def is_empty(a: Matrix) -> DataFrame:
    return _lit(a, 0 in a.shape)


def _mirrored(a: Matrix, tol: float, conjugate: bool) -> DataFrame:
    if a.nrows != a.ncols:
        return _lit(a, False)
    b = transposed(conj(a) if conjugate else a)
    if a.dtype.startswith("struct"):
        x = a.df.select("i", "j", F.col("v.re").alias("re"), F.col("v.im").alias("im"))
        y = b.df.select("i", "j", (-F.col("v.re")).alias("re"), (-F.col("v.im")).alias("im"))
        gap = x.unionByName(y).groupBy("i", "j").agg(F.hypot(F.sum("re"), F.sum("im")).alias("d"))
    else:
        gap = subtract(a, b).df.select(F.abs("v").alias("d"))
    return _all(gap, _small(F.col("d"), tol))


def is_symmetric(a: Matrix, tol: float = 0.0) -> DataFrame:
    return _mirrored(a, tol, False)


def is_hermitian(a: Matrix, tol: float = 0.0) -> DataFrame:
    return _mirrored(a, tol, True)


def is_banded(a: Matrix, below: int, above: int, tol: float = 0.0) -> DataFrame:
    """Nothing beyond ``tol`` further than ``below`` under or ``above`` over the diagonal."""
    inside = (F.col("j") - F.col("i")).between(-below, above)
    return _all(a.df, inside | _small(_magnitude(a), tol))


def is_upper_triangular(a: Matrix, tol: float = 0.0) -> DataFrame:
    return is_banded(a, 0, a.ncols, tol)


def is_lower_triangular(a: Matrix, tol: float = 0.0) -> DataFrame:
    return is_banded(a, a.nrows, 0, tol)


def is_triangular(a: Matrix, tol: float = 0.0) -> DataFrame:
    """One pass for both sides."""
    ok = _small(_magnitude(a), tol)
    up, low = (F.coalesce(F.bool_and(F.expr(s) | ok), F.lit(True)) for s in ("i <= j", "i >= j"))
    return a.df.agg((up | low).alias("value"))


def is_diagonal(a: Matrix, tol: float = 0.0) -> DataFrame:
    return is_banded(a, 0, 0, tol)


def is_diagonally_dominant(a: Matrix, strict: bool = False) -> DataFrame:
    """Each row's diagonal is at least (``strict``: over) the sum of its other magnitudes; rows without entries count; not square: false."""
    if a.nrows != a.ncols:
        return _lit(a, False)
    m = _magnitude(a)
    rows = a.df.groupBy("i").agg(F.sum(F.when(F.expr("i = j"), m).otherwise(0)).alias("d"), F.sum(F.when(F.expr("i <> j"), m).otherwise(0)).alias("o"), F.max(F.isnan(m.cast("double"))).alias("bad"))
    ok = ((F.col("d") > F.col("o")) if strict else (F.col("d") >= F.col("o"))) & ~F.col("bad")
    full = (F.count("i") == a.nrows) if strict else F.lit(True)
    return rows.agg((F.coalesce(F.bool_and(ok), F.lit(True)) & full).alias("value"))


def product_tol(a: Matrix) -> DataFrame:
    """The tolerance for products of A with itself: ``128 n eps max|a|^2``."""
    m = F.coalesce(F.max(_magnitude(a)), F.lit(0.0)).cast("double")
    return a.df.agg((F.lit(128.0 * max(a.shape) * EPS) * m * m).alias("value"))


def _near(a: Matrix, b: Matrix, tol: float) -> DataFrame:
    return _all(subtract(a, b).df, _small(F.abs("v"), tol))


def _tol(a: Matrix, tol: float | None) -> float:
    return float(product_tol(a).first()[0]) if tol is None else tol


def is_unitary(a: Matrix, tol: float | None = None) -> DataFrame:
    """``A^T A = I`` (real elements)."""
    if a.nrows != a.ncols:
        return _lit(a, False)
    x = a.map(lambda v: v.cast("double"))
    return _near(products.matmul(transposed(x), x), identity(a.df.sparkSession, a.nrows), _tol(a, tol))


is_orthogonal = is_unitary


def is_normal(a: Matrix, tol: float | None = None) -> DataFrame:
    """``A A^T = A^T A``."""
    if a.nrows != a.ncols:
        return _lit(a, False)
    x = a.map(lambda v: v.cast("double"))
    return _near(products.matmul(x, transposed(x)), products.matmul(transposed(x), x), _tol(a, tol))


def is_zero(x: Vector, tol: float = 0.0) -> DataFrame:
    return _all(x.df, _small(_magnitude(x), tol))


def is_finite(x: Vector) -> DataFrame:
    m = _magnitude(x).cast("double")
    return _all(x.df, ~F.isnan(m) & (m != float("inf")))


def has_nan(x: Vector) -> DataFrame:
    return x.df.agg(F.coalesce(F.bool_or(F.isnan(F.col("v").cast("double"))), F.lit(False)).alias("value"))


def has_inf(x: Vector) -> DataFrame:
    return x.df.agg(F.coalesce(F.bool_or(_magnitude(x).cast("double") == float("inf")), F.lit(False)).alias("value"))


def is_normalized(x: Vector, tol: float = 128 * EPS) -> DataFrame:
    return reductions.two_norm(x).select(_small(F.abs(F.col("value") - 1), tol).alias("value"))


is_unit = is_normalized


def is_orthogonal_to(x: Vector, y: Vector, tol: float = 128 * EPS) -> DataFrame:
    """``|x y| <= tol |x| |y|``, in one pass over the joined entries and one over each vector."""
    d = reductions.dot(x, y).select(F.abs(F.col("value").cast("double")).alias("d"))
    n = reductions.two_norm(x).withColumnRenamed("value", "n").crossJoin(reductions.two_norm(y).withColumnRenamed("value", "m"))
    row = d.crossJoin(n)  # one row each
    return row.select(((F.col("d") <= tol * F.col("n") * F.col("m")) & ~F.isnan("d")).alias("value"))
