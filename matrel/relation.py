"""Matrices and vectors as relations.

A ``Matrix`` is a DataFrame ``i, j, v`` with its dimensions, which no relation can know by itself (rows without
entries); a ``Vector`` is a DataFrame ``i, v`` with its length. Absent entries are zero. Indices start at 0. ``v`` is of any Spark
numeric type, or a struct ``re, im`` for complex numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _type_name(kind: T.DataType) -> str:
    return kind.simpleString()


@dataclass(frozen=True)
class Vector:
    df: DataFrame
    n: int

    @property
    def dtype(self) -> str:
        return _type_name(self.df.schema["v"].dataType)

    def map(self, f) -> Vector:
        """``f`` of every stored value."""
        return replace(self, df=self.df.select("i", f(F.col("v")).alias("v")))

    def dense(self) -> Vector:
        """All entries stored, zeros too."""
        grid = self.df.sparkSession.range(self.n).select(F.col("id").alias("i"))
        return replace(self, df=grid.join(self.df, "i", "left").select("i", F.coalesce("v", F.lit(0).cast(self.dtype)).alias("v")))

    def to_numpy(self) -> np.ndarray:
        """The whole vector on the driver: for results known to be small."""
        rows = self.df.collect()
        if self.dtype.startswith("struct"):
            out = np.zeros(self.n, complex)
            for r in rows:
                out[r["i"]] = complex(r["v"]["re"], r["v"]["im"])
            return out
        out = np.zeros(self.n, np.int64 if self.dtype in ("bigint", "int", "smallint", "tinyint") else np.float64)
        for r in rows:
            out[r["i"]] = r["v"]
        return out


@dataclass(frozen=True)
class Matrix:
    df: DataFrame
    nrows: int
    ncols: int

    @property
    def dtype(self) -> str:
        return _type_name(self.df.schema["v"].dataType)

    @property
    def shape(self) -> tuple[int, int]:
        return self.nrows, self.ncols

    @property
    def size(self) -> int:
        return self.nrows * self.ncols

    def map(self, f) -> Matrix:
        """``f`` of every stored value; right for the absent ones only if ``f(0) = 0`` (else map ``dense()``)."""
        return replace(self, df=self.df.select("i", "j", f(F.col("v")).alias("v")))

    def where(self, condition: Column) -> Matrix:
        return replace(self, df=self.df.where(condition))

    def dense(self) -> Matrix:
        """All entries stored, zeros too."""
        spark = self.df.sparkSession
        n = self.ncols
        grid = spark.range(self.nrows * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))
        return replace(self, df=grid.join(self.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0).cast(self.dtype)).alias("v")))

    def to_numpy(self) -> np.ndarray:
        """The whole matrix on the driver: for results known to be small."""
        rows = self.df.collect()
        if self.dtype.startswith("struct"):
            out = np.zeros(self.shape, complex)
            for r in rows:
                out[r["i"], r["j"]] = complex(r["v"]["re"], r["v"]["im"])
            return out
        out = np.zeros(self.shape, np.int64 if self.dtype in ("bigint", "int", "smallint", "tinyint") else np.float64)
        for r in rows:
            out[r["i"], r["j"]] = r["v"]
        return out


def same_shape(a: Matrix, b: Matrix) -> None:
    if a.shape != b.shape:
        raise ValueError(f"shapes differ: {a.shape} and {b.shape}")


def same_length(a: Vector, b: Vector) -> None:
    if a.n != b.n:
        raise ValueError(f"lengths differ: {a.n} and {b.n}")


INTEGRAL = ("bigint", "int", "smallint", "tinyint")


def need_field(x: Matrix | Vector | str) -> None:
    """Dividing algorithms need a field: integral elements are refused."""
    kind = x if isinstance(x, str) else x.dtype
    if kind in INTEGRAL:
        raise TypeError(f"elements of type {kind} aren't a field; cast them to double")


def matrix(spark: SparkSession, values: Sequence[Sequence[float]] | np.ndarray, keep_zeros: bool = False) -> Matrix:
    """A small matrix from the driver."""
    a = np.asarray(values)
    rows = [(int(i), int(j), a[i, j].item()) for i in range(a.shape[0]) for j in range(a.shape[1]) if keep_zeros or a[i, j] != 0]
    if np.iscomplexobj(a):
        return Matrix(spark.createDataFrame([(i, j, (v.real, v.imag)) for i, j, v in rows], "i long, j long, v struct<re:double,im:double>"), *a.shape)
    kind = "long" if np.issubdtype(a.dtype, np.integer) else "double"
    return Matrix(spark.createDataFrame(rows, f"i long, j long, v {kind}"), *a.shape)


def vector(spark: SparkSession, values: Sequence[float] | np.ndarray) -> Vector:
    """A small vector from the driver."""
    a = np.asarray(values)
    if np.iscomplexobj(a):
        return Vector(spark.createDataFrame([(k, (complex(v).real, complex(v).imag)) for k, v in enumerate(a)], "i long, v struct<re:double,im:double>"), len(a))
    kind = "long" if np.issubdtype(a.dtype, np.integer) else "double"
    return Vector(spark.createDataFrame([(k, v.item()) for k, v in enumerate(a)], f"i long, v {kind}"), len(a))


def rows_form(a: Matrix) -> DataFrame:
    """Compressed rows ``i, idx, val``, columns ascending."""
    packed = a.df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    return packed.select("i", F.col("r.j").alias("idx"), F.col("r.v").alias("val"))


def from_rows(df: DataFrame, nrows: int, ncols: int) -> Matrix:
    """Back from compressed rows."""
    flat = df.select("i", F.inline(F.arrays_zip(F.col("idx").alias("j"), F.col("val").alias("v"))).alias("j", "v"))
    return Matrix(flat, nrows, ncols)


def blocks_form(a: Matrix, size: int = 256) -> DataFrame:
    """Dense blocks ``bi, bj, block`` of doubles, row by row; a block without entries is absent."""
    cut = a.df.select(F.expr(f"i div {size}").alias("bi"), F.expr(f"j div {size}").alias("bj"), ((F.col("i") % size) * size + F.col("j") % size).cast("int").alias("k"), F.col("v").cast("double").alias("v"))
    return cut.groupBy("bi", "bj").agg(F.collect_list("k").alias("k"), F.collect_list("v").alias("v"))


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))
