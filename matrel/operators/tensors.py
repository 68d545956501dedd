"""Small tensors, one a row, as nested arrays; and index notation over relations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce as fold

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(values: Sequence) -> Column:
    """A nested list of numbers as nested arrays of doubles."""
    return F.array(*[literal(v) if isinstance(v, (list, tuple)) else F.lit(float(v)) for v in values])


def combine(a: Column, b: Column, rank: int, f) -> Column:
    """Component by component."""
    return f(a, b) if rank == 0 else F.zip_with(a, b, lambda x, y: combine(x, y, rank - 1, f))


def mapped(a: Column, rank: int, f) -> Column:
    return f(a) if rank == 0 else F.transform(a, lambda x: mapped(x, rank - 1, f))


def add(a: Column, b: Column, rank: int = 2) -> Column:
    return combine(a, b, rank, lambda x, y: x + y)


def subtract(a: Column, b: Column, rank: int = 2) -> Column:
    return combine(a, b, rank, lambda x, y: x - y)


def scale(a: Column, factor: float, rank: int = 2) -> Column:
    return mapped(a, rank, lambda x: x * F.lit(factor))


def divide(a: Column, factor: float, rank: int = 2) -> Column:
    return mapped(a, rank, lambda x: x / F.lit(factor))


def negate(a: Column, rank: int = 2) -> Column:
    return mapped(a, rank, lambda x: -x)


def equal(a: Column, b: Column) -> Column:
    return a == b


def at(t: Column, *index: int) -> Column:
    return fold(lambda x, k: F.get(x, k), index, t)


def trace(t: Column, dim: int) -> Column:
    return fold(lambda x, y: x + y, [at(t, k, k) for k in range(dim)])


def determinant(t: Column, dim: int) -> Column:
    """Closed forms for dimensions 2 and 3."""
    if dim == 2:
        return at(t, 0, 0) * at(t, 1, 1) - at(t, 0, 1) * at(t, 1, 0)
    if dim != 3:
        raise ValueError("dimension 2 or 3")
    minor = lambda a, b: at(t, 1, a) * at(t, 2, b) - at(t, 1, b) * at(t, 2, a)
    return at(t, 0, 0) * minor(1, 2) - at(t, 0, 1) * minor(0, 2) + at(t, 0, 2) * minor(0, 1)


def _flat(t: Column, rank: int) -> Column:
    for _ in range(rank - 1):
        t = F.flatten(t)
    return t


def frobenius_norm(t: Column, rank: int = 2) -> Column:
    return F.sqrt(F.aggregate(_flat(t, rank), F.lit(0.0), lambda s, x: s + x * x))


def transpose(t: Column, dim: int) -> Column:
    return F.array(*[F.array(*[at(t, j, i) for j in range(dim)]) for i in range(dim)])


def identity(dim: int) -> Column:
    return literal([[float(i == j) for j in range(dim)] for i in range(dim)])


euclidean_metric = identity


def minkowski_metric() -> Column:
    """diag(-1, 1, 1, 1)."""
    return literal([[(-1.0 if i == 0 else 1.0) if i == j else 0.0 for j in range(4)] for i in range(4)])


def is_symmetric(t: Column, dim: int, tol: float = 0.0) -> Column:
    return fold(lambda x, y: x & y, [F.abs(at(t, i, j) - at(t, j, i)) <= tol for i in range(dim) for j in range(i)], F.lit(True))


def is_antisymmetric(t: Column, dim: int, tol: float = 0.0) -> Column:
    """The diagonal must vanish too."""
    return fold(lambda x, y: x & y, [F.abs(at(t, i, j) + at(t, j, i)) <= tol for i in range(dim) for j in range(i + 1)], F.lit(True))


def pack_symmetric(t: Column, dim: int) -> Column:
    """The upper triangle row by row, each the mean of the two components it stands for."""
    return F.array(*[(at(t, i, j) + at(t, j, i)) / 2.0 for i in range(dim) for j in range(i, dim)])


def _packed(i: int, j: int, dim: int) -> int:
    i, j = min(i, j), max(i, j)
    return i * dim - i * (i - 1) // 2 + j - i


def unpack_symmetric(p: Column, dim: int) -> Column:
    return F.array(*[F.array(*[F.get(p, _packed(i, j, dim)) for j in range(dim)]) for i in range(dim)])


def trace_symmetric(p: Column, dim: int) -> Column:
    return fold(lambda x, y: x + y, [F.get(p, _packed(k, k, dim)) for k in range(dim)])


def _strict(i: int, j: int, dim: int) -> int:
    return i * (dim - 1) - i * (i - 1) // 2 + j - i - 1


def pack_antisymmetric(t: Column, dim: int) -> Column:
    """The strict upper triangle row by row, each half the difference of the two components."""
    return F.array(*[(at(t, i, j) - at(t, j, i)) / 2.0 for i in range(dim) for j in range(i + 1, dim)])


def unpack_antisymmetric(p: Column, dim: int) -> Column:
    def entry(i: int, j: int) -> Column:
        if i == j:
            return F.lit(0.0)
        return F.get(p, _strict(i, j, dim)) if i < j else -F.get(p, _strict(j, i, dim))

    return F.array(*[F.array(*[entry(i, j) for j in range(dim)]) for i in range(dim)])


def set_antisymmetric(p: Column, dim: int, i: int, j: int, value: float) -> Column:
    """One component set, its mirror with the other sign; on the diagonal nothing changes."""
    if i == j:
        return p
    k, v = (_strict(i, j, dim), value) if i < j else (_strict(j, i, dim), -value)
    return F.transform(p, lambda x, n: F.when(n == k, F.lit(float(v))).otherwise(x))


# Index notation: a tensor field is a relation of index columns and ``v``; names bind indices.


def relation(spark: SparkSession, values: Sequence, *names: str) -> DataFrame:
    """A nested list as a relation with the given index names."""
    rows: list[tuple] = []

    def walk(x, index: tuple) -> None:
        if isinstance(x, (list, tuple)):
            for k, y in enumerate(x):
                walk(y, (*index, k))
        else:
            rows.append((*index, float(x)))

    walk(values, ())
    return spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names) + ", v double")


def bind(t: DataFrame, *names: str) -> DataFrame:
    """Indices named anew."""
    return t.toDF(*names, "v")


def contract(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product summed over the indices both sides name: an equi-join on them and a sum."""
    left, right = a.columns[:-1], b.columns[:-1]
    shared = [n for n in left if n in right]
    rest = [n for n in [*left, *right] if n not in shared]
    x, y = a.withColumnRenamed("v", "x_"), b.withColumnRenamed("v", "y_")
    both = x.join(y, shared) if shared else x.crossJoin(y)
    if not shared:
        return both.select(*rest, (F.col("x_") * F.col("y_")).alias("v"))
    return both.groupBy(*rest).agg(F.sum(F.col("x_") * F.col("y_")).alias("v"))


def outer(a: DataFrame, b: DataFrame) -> DataFrame:
    """The tensor product; index names must differ."""
    if set(a.columns[:-1]) & set(b.columns[:-1]):
        raise ValueError("index names must differ")
    return contract(a, b)


def shift_index(metric: DataFrame, t: DataFrame, position: int = 0) -> DataFrame:
    """An index lowered by a metric (or raised by its inverse): ``w_i = g_ij v^j`` at that position."""
    names = t.columns[:-1]
    old = names[position]
    g = metric.toDF("i_", "j_", "g_")
    both = t.join(g, F.col(old) == F.col("j_"))
    keys = [F.col("i_").alias(n) if k == position else F.col(n) for k, n in enumerate(names)]
    return both.select(*keys, (F.col("g_") * F.col("v")).alias("v")).groupBy(*names).agg(F.sum("v").alias("v"))


lower = raise_ = shift_index


def lower_first(metric: DataFrame, t: DataFrame) -> DataFrame:
    return shift_index(metric, t, 0)


def lower_second(metric: DataFrame, t: DataFrame) -> DataFrame:
    return shift_index(metric, t, 1)


raise_first, raise_second = lower_first, lower_second
