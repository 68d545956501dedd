"""Element-wise maths: projections, and unions where two patterns meet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column
from pyspark.sql import functions as F

from matrel.functions import scalar
from matrel.relation import Matrix, Vector, same_length, same_shape


def _keys(a: Matrix | Vector) -> list[str]:
    return ["i"] if isinstance(a, Vector) else ["i", "j"]


def _check(a, b) -> None:
    (same_length if isinstance(a, Vector) else same_shape)(a, b)


def _like(a, df):
    return Vector(df, a.n) if isinstance(a, Vector) else Matrix(df, *a.shape)


def add(a, b, alpha=1, beta=1):
    """``alpha a + beta b`` of two matrices or two vectors: one union and one sum, whatever is stored on either side."""
    _check(a, b)
    kind = a.dtype if a.dtype == b.dtype else "double"
    term = lambda x, s: x.df.select(*_keys(a), (F.col("v") if s == 1 else F.col("v") * F.lit(s)).alias("v"))
    both = term(a, alpha).unionByName(term(b, beta))
    total = F.sum("v")
    if kind in ("tinyint", "smallint", "int", "bigint", "float") and isinstance(alpha, int) and isinstance(beta, int):
        total = total.cast(kind)
    return _like(a, both.groupBy(*_keys(a)).agg(total.alias("v")))


def subtract(a, b):
    return add(a, b, 1, -1)


def combine(a, b, f: Callable[[Column, Column], Column]):
    """``f`` of both values at every place stored on either side, zero standing for what is absent."""
    _check(a, b)
    x, y = (m.df.withColumnRenamed("v", n) for m, n in ((a, "x"), (b, "y")))
    both = x.join(y, _keys(a), "full_outer")
    zero = lambda c, m: F.coalesce(F.col(c), F.lit(0).cast(m.dtype))
    return _like(a, both.select(*_keys(a), f(zero("x", a), zero("y", b)).alias("v")))


def multiply(a, b):
    """The element-wise product: only places stored on both sides."""
    _check(a, b)
    both = a.df.withColumnRenamed("v", "x").join(b.df.withColumnRenamed("v", "y"), _keys(a))
    return _like(a, both.select(*_keys(a), (F.col("x") * F.col("y")).alias("v")))


def negate(a):
    return a.map(lambda v: -v)


def scale(a, alpha):
    return a.map(lambda v: F.lit(alpha) * v)


def divide(a, alpha):
    """By a number, as floating arithmetic has it (by zero: infinite or NaN, at the stored places)."""
    return a.map(scalar.divide_by(alpha))


def apply(a, name: str):
    """A function of ``functions.scalar.UNARY`` of every stored value; zeros are filled in first for functions that don't keep them."""
    f = scalar.UNARY[name]
    moves = name in ("acos", "acosh", "cos", "cosh", "erfc", "exp", "exp2", "log", "log10", "log2")
    return (a.dense() if moves else a).map(f)


def power(a, exponent: float):
    return (a.dense() if exponent <= 0 else a).map(lambda v: F.pow(v.cast("double"), F.lit(float(exponent))))


def absolute(a):
    return a.map(scalar.abs_of(a.dtype))


def conj(a):
    return a.map(scalar.conj_of(a.dtype))


def real(a):
    return a.map(scalar.real_of(a.dtype))


def imag(a):
    return a.map(scalar.imag_of(a.dtype))


def transform(a, f: Callable[[Column], Column]):
    """A function of one's own of every element."""
    return a.dense().map(f)


def evaluate(a):
    """``a`` as a value: what is made of it later reads the kept rows instead of computing them anew. Lost rows are computed again."""
    return _like(a, a.df.persist(StorageLevel.MEMORY_AND_DISK))


def fused_assign(a, *terms):
    """The sum of several matrices or vectors in the place of ``a``, with its shape and type, in one union and one sum."""
    first, *rest = terms
    _check(a, first)
    return fused_plus_assign(_like(a, first.df.select(*_keys(a), F.col("v").cast(a.dtype).alias("v"))), *rest)


def fused_plus_assign(a, *terms):
    """``a`` plus several matrices or vectors, in one union and one sum."""
    out = a.df
    for t in terms:
        _check(a, t)
        out = out.unionByName(t.df)
    return _like(a, out.groupBy(*_keys(a)).agg(F.sum("v").cast(a.dtype).alias("v")))
