"""Views and permutations: filters and renamed indices, nothing is copied.

A permutation is a relation ``new, old``: place ``new`` of the result takes what was at ``old``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.relation import Matrix, Vector, complex_of


def transposed(a: Matrix) -> Matrix:
    return Matrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), a.ncols, a.nrows)


def upper(a: Matrix) -> Matrix:
    return a.where(F.expr("i <= j"))


def lower(a: Matrix) -> Matrix:
    return a.where(F.expr("i >= j"))


def strict_upper(a: Matrix) -> Matrix:
    return a.where(F.expr("i < j"))


def strict_lower(a: Matrix) -> Matrix:
    return a.where(F.expr("i > j"))


def triu(a: Matrix, k: int = 0) -> Matrix:
    """On and above diagonal ``k``."""
    return a.where(F.col("j") - F.col("i") >= k)


def tril(a: Matrix, k: int = 0) -> Matrix:
    """On and below diagonal ``k``."""
    return a.where(F.col("j") - F.col("i") <= k)


def banded(a: Matrix, below: int, above: int) -> Matrix:
    return a.where((F.col("j") - F.col("i")).between(-below, above))


def hermitian(a: Matrix) -> Matrix:
    """Reads the upper triangle only; below it stands its conjugate."""
    up = upper(a).df
    value = complex_of(F.col("v.re"), -F.col("v.im")) if a.dtype.startswith("struct") else F.col("v")
    return Matrix(up.unionByName(up.where("i < j").select(F.col("j").alias("i"), F.col("i").alias("j"), value.alias("v"))), *a.shape)


def mapped(a: Matrix, rows: DataFrame, cols: DataFrame, nrows: int, ncols: int) -> Matrix:
    """Element (r, c) of the view is element (rows[r], cols[c]); the maps are relations ``new, old`` and may repeat or leave out."""
    r, c = (m.select(F.col("new").alias(f"n{x}"), F.col("old").alias(f"o{x}")) for x, m in (("i", rows), ("j", cols)))
    out = a.df.join(r, F.col("i") == F.col("oi")).join(c, F.col("j") == F.col("oj"))
    return Matrix(out.select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v"), nrows, ncols)


def sub_vector(x: Vector, start: int, stop: int, step: int = 1) -> Vector:
    """Every ``step``-th entry from ``start`` up to ``stop``, numbered anew."""
    kept = x.df.where((F.col("i") >= start) & (F.col("i") < stop) & ((F.col("i") - start) % step == 0))
    return Vector(kept.select(F.expr(f"(i - {start}) div {step}").alias("i"), "v"), max(0, -(-(min(stop, x.n) - start) // step)))


def sub_matrix(a: Matrix, row0: int, row1: int, col0: int, col1: int) -> Matrix:
    kept = a.df.where((F.col("i") >= row0) & (F.col("i") < row1) & (F.col("j") >= col0) & (F.col("j") < col1))
    return Matrix(kept.select((F.col("i") - row0).alias("i"), (F.col("j") - col0).alias("j"), "v"), row1 - row0, col1 - col0)


def permutation(spark: SparkSession, old: Sequence[int]) -> DataFrame:
    return spark.createDataFrame([(k, int(o)) for k, o in enumerate(old)], "new long, old long")


def identity_permutation(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("new"), F.col("id").alias("old"))


def invert_permutation(p: DataFrame) -> DataFrame:
    return p.select(F.col("old").alias("new"), F.col("new").alias("old"))


def compose_permutations(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a[b[i]]``."""
    return b.select("new", F.col("old").alias("mid")).join(a.select(F.col("new").alias("mid"), "old"), "mid").select("new", "old")


def is_valid_permutation(p: DataFrame, n: int) -> DataFrame:
    """Whether it is a bijection on 0..n-1."""
    ok = (F.count("old") == n) & (F.count_distinct("old") == n) & (F.count_distinct("new") == n) & (F.coalesce(F.min("old"), F.lit(0)) >= 0) & (F.coalesce(F.max("old"), F.lit(-1)) < n)
    return p.agg(ok.alias("value"))


def swap_rows(p: DataFrame, a: int, b: int) -> DataFrame:
    """The permutation with the sources of two places exchanged."""
    return p.select(F.when(F.col("new") == a, b).when(F.col("new") == b, a).otherwise(F.col("new")).cast("long").alias("new"), "old")


def row_permute(a: Matrix, p: DataFrame) -> Matrix:
    """Row ``new`` of the result is row ``old``."""
    return Matrix(a.df.join(p, F.col("i") == F.col("old")).select(F.col("new").alias("i"), "j", "v"), *a.shape)


def column_permute(a: Matrix, p: DataFrame) -> Matrix:
    return Matrix(a.df.join(p, F.col("j") == F.col("old")).select("i", F.col("new").alias("j"), "v"), *a.shape)


def symmetric_permute(a: Matrix, p: DataFrame) -> Matrix:
    """Rows and columns alike."""
    return column_permute(row_permute(a, p), p)


reorder_rows, reorder_cols, reorder = row_permute, column_permute, symmetric_permute


def permute_vector(x: Vector, p: DataFrame) -> Vector:
    """``y[i] = x[p[i]]``."""
    return Vector(x.df.join(p, F.col("i") == F.col("old")).select(F.col("new").alias("i"), "v"), x.n)


def ipermute_vector(x: Vector, p: DataFrame) -> Vector:
    """``y[p[i]] = x[i]``."""
    return permute_vector(x, invert_permutation(p))


def permutation_matrix(p: DataFrame, n: int, kind: str = "double") -> Matrix:
    """Row ``new`` has its 1 in column ``old``."""
    return Matrix(p.select(F.col("new").alias("i"), F.col("old").alias("j"), F.lit(1).cast(kind).alias("v")), n, n)


def quadrants(a: Matrix) -> dict[str, Matrix]:
    """The four parts of a recursive split: at the largest power of two below the larger dimension."""
    n = max(a.shape)
    at = 1 if n <= 1 else 1 << ((n - 1).bit_length() - 1)
    r, c = min(at, a.nrows), min(at, a.ncols)
    return {"north_west": sub_matrix(a, 0, r, 0, c), "north_east": sub_matrix(a, 0, r, c, a.ncols), "south_west": sub_matrix(a, r, a.nrows, 0, c), "south_east": sub_matrix(a, r, a.nrows, c, a.ncols)}


def is_base_case(a: Matrix, most: int, smaller: bool = False) -> bool:
    """Whether recursion stops: the larger dimension (or the smaller one) is at most ``most``."""
    return (min if smaller else max)(a.shape) <= most


def for_each(a: Matrix, most: int, f) -> list:
    """``f(block, row offset, column offset)`` of every non-empty base block, in recursion order."""
    out = []

    def go(x: Matrix, r: int, c: int) -> None:
        if 0 in x.shape:
            return
        if is_base_case(x, most):
            out.append(f(x, r, c))
            return
        parts = quadrants(x)
        h, w = parts["north_west"].shape
        for name, part in parts.items():
            go(part, r + (h if "south" in name else 0), c + (w if "east" in name else 0))

    go(a, 0, 0)
    return out


def morton(i, j, bits: int = 16):
    """The Z-order place of (i, j): their bits interleaved, row bits above column bits. A key that keeps neighbours together."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for k, x in enumerate((j, i)):
            bit = F.shiftright(x.cast("long"), b).bitwiseAND(F.lit(1).cast("long"))
            out = out.bitwiseOR(F.shiftleft(bit, 2 * b + k))
    return out


def doppled(i, j, block_bits: int, bits: int = 16, row_major: bool = True):
    """Z-order between blocks of ``2**block_bits`` and plain row (or column) order within."""
    size = 1 << block_bits
    within = (i % size) * size + j % size if row_major else (j % size) * size + i % size
    return F.shiftleft(morton(F.shiftright(i.cast("long"), block_bits), F.shiftright(j.cast("long"), block_bits), bits), 2 * block_bits) + within
