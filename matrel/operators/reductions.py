"""Reductions and norms: one-row frames ``value``. Zeros that aren't stored count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matrel.functions.accumulators import PLAIN, Accumulator
from matrel.functions.scalar import abs_of, identity_of
from matrel.operators import products
from matrel.relation import Matrix, Vector, same_length


def _places(a: Matrix | Vector) -> int:
    return a.n if isinstance(a, Vector) else a.size


def _abs(a: Matrix | Vector) -> Column:
    return abs_of(a.dtype)(F.col("v"))


def _squared(a: Matrix | Vector) -> Column:
    v = F.col("v")
    return v["re"] * v["re"] + v["im"] * v["im"] if a.dtype.startswith("struct") else v.cast("double") * v.cast("double")


def _sum_type(kind: str) -> str:
    return kind if kind in ("float", "double") else "bigint" if kind in ("tinyint", "smallint", "int", "bigint") else kind


def total(a: Matrix | Vector) -> DataFrame:
    kind = _sum_type(a.dtype)
    return a.df.agg(F.coalesce(F.sum("v"), F.lit(0)).cast(kind).alias("value"))


def product(a: Matrix | Vector) -> DataFrame:
    """1 for an empty collection, 0 if any place is not stored."""
    return a.df.agg(F.when(F.count("v") < _places(a), 0.0).otherwise(F.coalesce(F.product("v"), F.lit(1.0))).alias("value"))


def _extreme(a: Matrix | Vector, name: str) -> DataFrame:
    real = F.when(~F.isnan(F.col("v").cast("double")), F.col("v"))
    pick, both = (F.min, F.least) if name == "min" else (F.max, F.greatest)
    zero = F.lit(0).cast(a.dtype)
    # least and greatest skip the null of a full collection
    value = both(pick(real), F.when(F.count("v") < _places(a), zero), F.lit(identity_of(name, a.dtype)).cast(a.dtype))
    return a.df.agg(value.alias("value"))


def minimum(a: Matrix | Vector) -> DataFrame:
    """NaN doesn't count; nothing gives the type's largest number."""
    return _extreme(a, "min")


def maximum(a: Matrix | Vector) -> DataFrame:
    return _extreme(a, "max")


def trace(a: Matrix) -> DataFrame:
    return a.df.where("i = j").agg(F.coalesce(F.sum("v"), F.lit(0)).cast(_sum_type(a.dtype)).alias("value"))


def dot(x: Vector, y: Vector, accumulator: Accumulator = PLAIN, conjugate: bool = True) -> DataFrame:
    """The sum of ``conj(x) y``; ``conjugate=False`` leaves x as it is."""
    same_length(x, y)
    both = x.df.withColumnRenamed("v", "a").join(y.df.withColumnRenamed("v", "b"), "i")
    a, b = F.col("a"), F.col("b")
    if x.dtype.startswith("struct"):
        sign = 1 if conjugate else -1
        re = F.sum(a["re"] * b["re"] + sign * a["im"] * b["im"])
        im = F.sum(a["re"] * b["im"] - sign * a["im"] * b["re"])
        return both.agg(F.coalesce(re, F.lit(0.0)).alias("re"), F.coalesce(im, F.lit(0.0)).alias("im"))
    value = accumulator.sum_of_products(a, b)
    return both.agg(F.coalesce(value, F.lit(0)).alias("value") if not (accumulator.fused or accumulator.exact) else value.alias("value"))


def dot_real(x: Vector, y: Vector, accumulator: Accumulator = PLAIN) -> DataFrame:
    return dot(x, y, accumulator, conjugate=False)


def dot_wrapped(x: Vector, y: Vector, bits: int = 32) -> DataFrame:
    """Narrow integers multiplied and summed exactly, then reduced modulo ``2**bits``."""
    from matrel.functions.scalar import wrapped

    both = x.df.withColumnRenamed("v", "a").join(y.df.withColumnRenamed("v", "b"), "i")
    exact = F.sum(F.col("a").cast("decimal(19,0)") * F.col("b").cast("decimal(19,0)"))
    return both.agg(wrapped(F.coalesce(exact, F.lit(0)), bits).alias("value"))


def one_norm(a: Matrix | Vector) -> DataFrame:
    """Of a vector the sum of magnitudes; of a matrix the largest such sum of a column."""
    if isinstance(a, Vector):
        return a.df.agg(F.coalesce(F.sum(_abs(a)), F.lit(0)).alias("value"))
    return a.df.groupBy("j").agg(F.sum(_abs(a)).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("value"))


def infinity_norm(a: Matrix | Vector) -> DataFrame:
    """Of a vector the largest magnitude; of a matrix the largest sum of a row."""
    if isinstance(a, Vector):
        return a.df.agg(F.coalesce(F.max(_abs(a)), F.lit(0)).alias("value"))
    return a.df.groupBy("i").agg(F.sum(_abs(a)).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0)).alias("value"))


def two_norm(x: Vector, accumulator: Accumulator = PLAIN) -> DataFrame:
    if accumulator is PLAIN or x.dtype.startswith("struct"):
        return x.df.agg(F.sqrt(F.coalesce(F.sum(_squared(x)), F.lit(0.0))).alias("value"))
    value = F.sqrt(accumulator.round_out(accumulator.sum_of_products(F.col("v"), F.col("v"))))
    return x.df.agg((value.cast(accumulator.result) if accumulator.result else value).alias("value"))


def frobenius_norm(a: Matrix) -> DataFrame:
    return a.df.agg(F.sqrt(F.coalesce(F.sum(_squared(a)), F.lit(0.0))).alias("value"))


def backward_error(a: Matrix, x: Vector, b: Vector) -> DataFrame:
    """``|b - Ax| / (|A| |x| + |b|)`` in the infinity norm; 0 / 0 is 0."""
    from matrel.operators.elementwise import subtract

    rest = subtract(Vector(b.df.select("i", F.col("v").cast("double").alias("v")), b.n), Vector(products.mult(a, x).df.select("i", F.col("v").cast("double").alias("v")), a.nrows))
    parts = [infinity_norm(m).withColumnRenamed("value", n) for m, n in ((rest, "r"), (a, "a"), (x, "x"), (b, "b"))]
    row = parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(parts[3])  # one row each
    below = F.col("a") * F.col("x") + F.col("b")
    return row.select(F.when(below == 0, F.when(F.col("r") == 0, 0.0).otherwise(float("inf"))).otherwise(F.try_divide(F.col("r").cast("double"), below.cast("double"))).alias("value"))
