"""Arrays of any rank as relations ``d0, ..., d{N-1}, v`` with a shape. Every element is stored."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.functions.scalar import identity_of


def strides(shape: Sequence[int], order: str = "C") -> tuple[int, ...]:
    """Elements between neighbours along each axis, in row-major ("C") or column-major ("F") order."""
    out, step = [], 1
    for n in reversed(shape) if order == "C" else shape:
        out.append(step)
        step *= n
    return tuple(reversed(out)) if order == "C" else tuple(out)


def broadcast_shape(a: Sequence[int], b: Sequence[int]) -> tuple[int, ...] | None:
    """The common shape of two of equal rank, or None: extents must agree or be 1."""
    if len(a) != len(b) or any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
        return None
    return tuple(y if x == 1 else x for x, y in zip(a, b, strict=True))


def broadcast_strides(shape: Sequence[int], to: Sequence[int], order: str = "C") -> tuple[int, ...]:
    """Strides of an array seen in a larger shape: 0 along stretched axes."""
    return tuple(0 if n == 1 and m != 1 else s for n, m, s in zip(shape, to, strides(shape, order), strict=True))


def is_c_contiguous(a: NdArray) -> bool:
    """Whether storage order is row by row. A relation has no gaps, so its order alone decides."""
    return a.order == "C" or a.rank <= 1


def is_f_contiguous(a: NdArray) -> bool:
    """Whether storage order is column by column."""
    return a.order == "F" or a.rank <= 1


def is_view(a: NdArray) -> bool:
    """Whether the elements belong to another array: a relation that selects from one does, until it is written or kept."""
    return not a.df.is_cached


@dataclass(frozen=True)
class NdArray:
    df: DataFrame
    shape: tuple[int, ...]
    order: str = "C"

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"d{k}" for k in range(self.rank)]

    @property
    def dtype(self) -> str:
        return self.df.schema["v"].dataType.simpleString()

    def flat_index(self, order: str | None = None) -> Column:
        """An element's place in storage order."""
        out = F.lit(0).cast("long")
        for d, s in zip(self.axes, strides(self.shape, order or self.order), strict=True):
            out = out + F.col(d) * s
        return out

    def map(self, f: Callable[[Column], Column]) -> NdArray:
        return NdArray(self.df.select(*self.axes, f(F.col("v")).alias("v")), self.shape, self.order)


def _unflat(flat: DataFrame, shape: Sequence[int], order: str) -> NdArray:
    """From ``flat, v`` to an array."""
    index = [F.expr(f"(flat div {s}) % {max(1, n)}").alias(f"d{k}") for k, (n, s) in enumerate(zip(shape, strides(shape, order), strict=True))]
    return NdArray(flat.select(*index, "v"), tuple(shape), order)


def from_values(spark: SparkSession, values: Sequence[float], shape: Sequence[int], order: str = "C") -> NdArray:
    kind = "long" if all(isinstance(v, int) for v in values) else "double"
    return _unflat(spark.createDataFrame([(k, v if kind == "long" else float(v)) for k, v in enumerate(values)], f"flat long, v {kind}"), shape, order)


def fill(a: NdArray, value: float) -> NdArray:
    return a.map(lambda _: F.lit(value).cast(a.dtype))


def flat(a: NdArray) -> DataFrame:
    """``flat, v`` by storage position."""
    return a.df.select(a.flat_index().alias("flat"), "v")


def flatten(a: NdArray) -> NdArray:
    """One axis, in logical (row-major) order whatever the storage."""
    return NdArray(a.df.select(a.flat_index("C").alias("d0"), "v"), (a.size,), "C")


def reshape(a: NdArray, shape: Sequence[int]) -> NdArray:
    """Another shape of the same size, elements in the array's own order."""
    if math.prod(shape) != a.size:
        raise ValueError(f"{a.shape} doesn't fit {tuple(shape)}")
    return _unflat(flat(a), shape, a.order)


def transpose(a: NdArray) -> NdArray:
    """Axes reversed, and the order with them: only names change."""
    named = [F.col(d).alias(f"d{a.rank - 1 - k}") for k, d in enumerate(a.axes)]
    moved = a.df.select(*named, "v").select(*a.axes, "v")
    return NdArray(moved, a.shape[::-1], "F" if a.order == "C" else "C")


def slice_(a: NdArray, *index: int | slice) -> NdArray:
    """A number takes one place and drops its axis; a slice takes a half-open range with a positive step."""
    if len(index) != a.rank:
        raise ValueError(f"{a.rank} indices are needed")
    where, kept, shape = F.lit(True), [], []
    for d, n, x in zip(a.axes, a.shape, index, strict=True):
        if isinstance(x, int):
            if not 0 <= x < n:
                raise IndexError(f"{x} isn't in 0..{n - 1}")
            where = where & (F.col(d) == x)
            continue
        start, stop, step = 0 if x.start is None else x.start, n if x.stop is None else x.stop, x.step or 1
        if not 0 <= start <= stop <= n or step < 1:
            raise IndexError(f"{x} doesn't fit 0..{n}")
        where = where & (F.col(d) >= start) & (F.col(d) < stop) & ((F.col(d) - start) % step == 0)
        kept.append(F.expr(f"({d} - {start}) div {step}").alias(f"d{len(kept)}"))
        shape.append(-(-(stop - start) // step))
    return NdArray(a.df.where(where).select(*kept, "v"), tuple(shape), a.order)


def combine(a: NdArray, b: NdArray, f: Callable[[Column, Column], Column]) -> NdArray:
    """Element by element with broadcasting: an axis of extent 1 isn't part of the join, so its element meets the whole other axis."""
    shape = broadcast_shape(a.shape, b.shape)
    if shape is None:
        raise ValueError(f"shapes {a.shape} and {b.shape} don't broadcast")
    on = [d for d, n, m in zip(a.axes, a.shape, b.shape, strict=True) if n == m]
    x = a.df.withColumnRenamed("v", "x").drop(*[d for d, n, m in zip(a.axes, a.shape, b.shape, strict=True) if n == 1 != m])
    y = b.df.withColumnRenamed("v", "y").drop(*[d for d, n, m in zip(a.axes, a.shape, b.shape, strict=True) if m == 1 != n])
    # without a shared axis one side is a single element, or the result is the outer product the shapes ask for
    both = x.join(y, on) if on else x.crossJoin(y)
    return NdArray(both.select(*a.axes, f(F.col("x"), F.col("y")).alias("v")), shape, a.order)


def _integral(a: NdArray) -> bool:
    return a.dtype in ("tinyint", "smallint", "int", "bigint")


def sum_all(a: NdArray) -> DataFrame:
    return a.df.agg(F.coalesce(F.sum("v"), F.lit(0)).alias("value"))


def prod_all(a: NdArray) -> DataFrame:
    return a.df.agg(F.coalesce(F.product("v"), F.lit(1.0)).alias("value"))


def _extreme(a: NdArray, name: str) -> DataFrame:
    pick, both = (F.min, F.least) if name == "min" else (F.max, F.greatest)
    return a.df.agg(both(pick(F.when(~F.isnan(F.col("v").cast("double")), F.col("v"))), F.lit(identity_of(name, a.dtype)).cast(a.dtype)).alias("value"))


def min_all(a: NdArray) -> DataFrame:
    return _extreme(a, "min")


def max_all(a: NdArray) -> DataFrame:
    return _extreme(a, "max")


def _over(total: Column, n: int, integral: bool) -> Column:
    """Division in the element type: whole numbers are cut towards zero."""
    if not integral:
        return total / F.lit(float(n))
    whole = F.abs(total) - F.abs(total) % n
    return (F.signum(total) * (whole / n)).cast("bigint")


def mean_all(a: NdArray) -> DataFrame:
    return a.df.agg(_over(F.sum("v"), a.size, _integral(a)).alias("value"))


def sum_axis(a: NdArray, axis: int) -> NdArray:
    rest = [d for k, d in enumerate(a.axes) if k != axis]
    summed = a.df.groupBy(*rest).agg(F.sum("v").alias("v"))
    return NdArray(summed.select(*[F.col(d).alias(f"d{k}") for k, d in enumerate(rest)], "v"), tuple(n for k, n in enumerate(a.shape) if k != axis), a.order)


def mean_axis(a: NdArray, axis: int) -> NdArray:
    return sum_axis(a, axis).map(lambda v: _over(v, a.shape[axis], _integral(a)))


def transform(a: NdArray, f: Callable[[Column], Column]) -> NdArray:
    return a.map(f)


def reduce(a: NdArray, start: Column, f: Callable[[Column, Column], Column]) -> DataFrame:
    """A fold in logical order. Order forces one row to hold all elements: for arrays that fit in one."""
    packed = a.df.agg(F.array_sort(F.collect_list(F.struct(a.flat_index("C").alias("k"), "v"))).alias("r"))
    return packed.select(F.aggregate(F.col("r.v"), start, f).alias("value"))
