"""Products: an equi-join on the contraction index and a sum, which Spark splits into partial and final sums.

Neither side is broadcast by hand: Spark broadcasts a side whose size it knows to be small and sort-merges otherwise.
Products with many places go by groups of rows and columns, see ``_gathered``, or by blocks of rows (or columns), see ``_blocked``. Dense products can go by blocks both ways: the join is then on block
numbers and NumPy multiplies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.functions.accumulators import PLAIN, Accumulator
from matrel.functions.scalar import wrapped
from matrel.operators import _gathered
from matrel.operators.elementwise import add, scale
from matrel.operators.views import lower, strict_lower, strict_upper, transposed, upper
from matrel.relation import Matrix, Vector, blocks_form, same_length, same_shape


#: Places up to which partial sums are few enough to be shuffled. Else rows of the result a block has at most, blocks there are at least, entries packed in a row.
PLACES, BLOCK, BLOCKS, PACKED = 1 << 20, 512, 64, 4096
#: Entries of both factors up to which what blocks send is small.
ENTRIES = 1 << 16


def axpy(alpha: float, x: Vector, y: Vector) -> Vector:
    """``alpha x + y``."""
    return add(x, y, alpha, 1)


def mult(a: Matrix, x: Vector, accumulator: Accumulator = PLAIN) -> Vector:
    """``A x``; rows without stored terms are absent (zero)."""
    if a.ncols != x.n:
        raise ValueError(f"{a.shape} times {x.n}")
    met = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("a")).join(x.df.select(F.col("i").alias("k"), F.col("v").alias("b")), "k")
    return Vector(met.groupBy("i").agg(accumulator.sum_of_products(F.col("a"), F.col("b")).alias("v")), a.nrows)


def mult_transposed(a: Matrix, x: Vector, accumulator: Accumulator = PLAIN) -> Vector:
    """``A^T x`` without forming the transpose."""
    return mult(transposed(a), x, accumulator)


def matmul(a: Matrix, b: Matrix, accumulator: Accumulator = PLAIN) -> Matrix:
    """``A B``. Entries that cancel stay stored as zeros, so the pattern depends on the patterns alone."""
    if a.ncols != b.nrows:
        raise ValueError(f"{a.shape} times {b.shape}")
    if a.nrows * b.ncols > PLACES:
        return _large(a, b, accumulator)
    met = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("a")).join(b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("b")), "k")
    return Matrix(met.groupBy("i", "j").agg(accumulator.sum_of_products(F.col("a"), F.col("b")).alias("v")), a.nrows, b.ncols)


def _large(a: Matrix, b: Matrix, accumulator: Accumulator, same: bool = False) -> Matrix:
    """``A B`` with many places. Long elements go by groups if no sum can reach 2**62 and all have values and places, the rest by blocks. ``same``: B is A transposed."""
    if accumulator == PLAIN and a.dtype == b.dtype == "bigint":
        rows = _gathered.groups(a.df, "i", "j", a.nrows)
        columns = rows if same or rows is None else _gathered.groups(b.df, "j", "i", b.ncols)
        if rows and columns and max(rows.n, columns.n) > ENTRIES and rows.total * columns.total < 2**62:
            return _gathered.product(a, b, rows, columns, same)
    return _blocked(a, b, accumulator)


def _blocked(a: Matrix, b: Matrix, accumulator: Accumulator) -> Matrix:
    """``A B`` by blocks of the result's rows, or columns if these are more: all terms of a place are summed where its block is, none is shuffled.

    What is shuffled is each factor by the contraction index, and then, packed, what of a factor's row an index sends to each block that holds the index:
    at most as many numbers as there are terms, and far fewer where near rows meet in the same indices. Packed rows hold at most ``BLOCK`` and ``PACKED`` entries.
    """
    spark = a.df.sparkSession
    x = a.df.select(F.col("j").alias("k"), F.col("i").alias("p"), F.col("v").alias("a"))
    y = b.df.select(F.col("i").alias("k"), F.col("j").alias("q"), F.col("v").alias("b"))
    by_rows, longest = a.nrows >= b.ncols, max(a.nrows, b.ncols)
    width = min(BLOCK, -(-longest // BLOCKS))
    n = 4 * min(-(-longest // width), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def packed(df: DataFrame, index: str, value: str, size: int, name: str) -> DataFrame:
        rows = df.repartition("k").groupBy("k", F.expr(f"{index} div {size}").alias(name)).agg(F.collect_list(F.struct(index, value)).alias("r"))
        return rows.select("k", name, F.col(f"r.{index}").alias(f"{index}s"), F.col(f"r.{value}").alias(f"{value}s"))

    left, right = packed(x, "p", "a", width if by_rows else PACKED, "g" if by_rows else "h"), packed(y, "q", "b", PACKED if by_rows else width, "h" if by_rows else "g")
    met = left.join(right, "k").select("g", "ps", "as", "qs", "bs").repartition(n, "g")
    met = met.select("g", F.arrays_zip("ps", "as").alias("r"), F.arrays_zip("qs", "bs").alias("s"))
    met = met.select("g", "s", F.inline("r").alias("p", "a")).select("g", "p", "a", F.inline("s").alias("q", "b"))
    summed = met.groupBy("g", "p", "q").agg(accumulator.sum_of_products(F.col("a"), F.col("b")).alias("v"))
    return Matrix(summed.select(F.col("p").alias("i"), F.col("q").alias("j"), "v"), a.nrows, b.ncols)


spgemm = matmul


def matmul_quad(a: Matrix, b: Matrix) -> Matrix:
    """8-bit unsigned times signed into 32 bits that wrap."""
    out = matmul(Matrix(a.df.select("i", "j", F.col("v").cast("bigint").alias("v")), *a.shape), Matrix(b.df.select("i", "j", F.col("v").cast("bigint").alias("v")), *b.shape))
    return out.map(lambda v: wrapped(v, 32))


#: Blocks of partial sums a task keeps before it passes them on, and parts into which the partial sums of one block are dealt for their first sum.
HELD, DEALT = 64, 16


def matmul_blocks(a: Matrix, b: Matrix, size: int = 256) -> Matrix:
    """The product of dense matrices by blocks of ``size``: NumPy multiplies pairs of blocks, a task sums what it makes for one place.

    What tasks pass on is summed in two rounds, of which the first deals the partial sums of a place over ``DEALT`` groups.
    """
    if a.ncols != b.nrows:
        raise ValueError(f"{a.shape} times {b.shape}")
    nrows, ncols = a.nrows, b.ncols
    x = blocks_form(a, size).select(F.col("bi").alias("i"), F.col("bj").alias("t"), F.col("k").alias("ka"), F.col("v").alias("va"))
    y = blocks_form(b, size).select(F.col("bi").alias("t"), F.col("bj").alias("j"), F.col("k").alias("kb"), F.col("v").alias("vb"))

    def block(k: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros(size * size)
        out[np.asarray(k)] = v
        return out.reshape(size, size)

    def times(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame({"i": [i for i, _ in held], "j": [j for _, j in held], "block": [v.reshape(-1) for v in held.values()]})

        for f in frames:
            for i, j, ka, va, kb, vb in zip(f["i"], f["j"], f["ka"], f["va"], f["kb"], f["vb"], strict=True):
                if (i, j) not in held and len(held) >= HELD:
                    yield out()
                    held.clear()
                made = block(ka, va) @ block(kb, vb)
                held[i, j] = held[i, j] + made if (i, j) in held else made
        if held:
            yield out()

    def summed(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "j": f["j"].iloc[:1], "block": [np.sum(np.stack(f["block"].to_list()), axis=0)]})

    def total(f: pd.DataFrame) -> pd.DataFrame:
        flat = np.sum(np.stack(f["block"].to_list()), axis=0)
        k = np.arange(size * size)
        rows, cols = f["i"].iloc[0] * size + k // size, f["j"].iloc[0] * size + k % size
        ok = (rows < nrows) & (cols < ncols)
        return pd.DataFrame({"i": rows[ok], "j": cols[ok], "v": flat[ok]})

    kind = "i long, j long, block array<double>"
    parts = x.join(y, "t").select("i", "j", "ka", "va", "kb", "vb").mapInPandas(times, kind)
    if a.ncols > DEALT * size:
        parts = parts.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(DEALT))).groupBy("i", "j", "part").applyInPandas(lambda f: summed(f), kind)
    return Matrix(parts.groupBy("i", "j").applyInPandas(total, "i long, j long, v double"), nrows, ncols)


def chain(*factors: Matrix | Vector, accumulator: Accumulator = PLAIN) -> Matrix | Vector:
    """A product of matrices, of which the last may be a vector, in the cheapest order: ``(A B) x`` runs as ``A (B x)``.

    Catalyst can't move a join through the sum between them, so the order is chosen here by the classic dynamic programme over dimensions.
    """
    *rest, last = factors
    if isinstance(last, Vector):
        out = last
        for m in reversed(rest):
            out = mult(m, out, accumulator)
        return out
    dims = [m.nrows for m in factors] + [factors[-1].ncols]
    n = len(factors)
    cost = [[0] * n for _ in range(n)]
    cut = [[0] * n for _ in range(n)]
    for width in range(1, n):
        for s in range(n - width):
            e = s + width
            options = [(cost[s][k] + cost[k + 1][e] + dims[s] * dims[k + 1] * dims[e + 1], k) for k in range(s, e)]
            cost[s][e], cut[s][e] = min(options)

    def build(s: int, e: int) -> Matrix:
        return factors[s] if s == e else matmul(build(s, cut[s][e]), build(cut[s][e] + 1, e), accumulator)

    return build(0, n - 1)


def kron(a: Matrix, b: Matrix) -> Matrix:
    """The Kronecker product. Every entry meets every entry by definition: the result has as many rows as the plan."""
    x, y = a.df.toDF("i", "j", "a"), b.df.toDF("p", "q", "b")
    out = x.crossJoin(y).select((F.col("i") * b.nrows + F.col("p")).alias("i"), (F.col("j") * b.ncols + F.col("q")).alias("j"), (F.col("a") * F.col("b")).alias("v"))
    return Matrix(out, a.nrows * b.nrows, a.ncols * b.ncols)


def outer(x: Vector, y: Vector) -> Matrix:
    out = x.df.toDF("i", "a").crossJoin(y.df.toDF("j", "b"))
    return Matrix(out.select("i", "j", (F.col("a") * F.col("b")).alias("v")), x.n, y.n)


def ger(a: Matrix, alpha: float, x: Vector, y: Vector) -> Matrix:
    """``A + alpha x y^T``."""
    return add(a, outer(x, y), 1, alpha)


def _axpby(alpha, x, beta, y):
    return scale(x, alpha) if beta == 0 or y is None else add(x, y, alpha, beta)


def symv(a: Matrix, x: Vector, alpha: float = 1, beta: float = 0, y: Vector | None = None) -> Vector:
    """``alpha A x + beta y``."""
    return _axpby(alpha, mult(a, x), beta, y)


def _triangle(a: Matrix, lower_part: bool, unit: bool) -> Matrix:
    if not unit:
        return lower(a) if lower_part else upper(a)
    rest = strict_lower(a) if lower_part else strict_upper(a)
    ones = a.df.sparkSession.range(a.nrows).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1).cast(a.dtype).alias("v"))
    return Matrix(rest.df.unionByName(ones), *a.shape)


def trmv(a: Matrix, x: Vector, lower_part: bool = False, unit: bool = False) -> Vector:
    """A triangle of A times x; the other triangle isn't read, a unit diagonal isn't either."""
    return mult(_triangle(a, lower_part, unit), x)


def trmm(a: Matrix, b: Matrix, alpha: float = 1, lower_part: bool = False, unit: bool = False) -> Matrix:
    return scale(matmul(_triangle(a, lower_part, unit), b), alpha)


def symm(a: Matrix, b: Matrix, alpha: float = 1, beta: float = 0, c: Matrix | None = None) -> Matrix:
    return _axpby(alpha, matmul(a, b), beta, c)


def syrk(a: Matrix, alpha: float = 1, beta: float = 0, c: Matrix | None = None) -> Matrix:
    """``alpha A A^T + beta C``, both triangles."""
    made = _large(a, transposed(a), PLAIN, same=True) if a.nrows**2 > PLACES else matmul(a, transposed(a))
    return _axpby(alpha, made, beta, c)


def syr2k(a: Matrix, b: Matrix, alpha: float = 1, beta: float = 0, c: Matrix | None = None) -> Matrix:
    """``alpha (A B^T + B A^T) + beta C``."""
    same_shape(a, b)
    return _axpby(alpha, add(matmul(a, transposed(b)), matmul(b, transposed(a))), beta, c)


def block_diagonal_times(blocks: DataFrame, x: DataFrame) -> DataFrame:
    """Blocks ``blk, i, j, v`` times parts ``blk, i, v``: the block is part of the join key, so nothing crosses blocks."""
    met = blocks.select("blk", "i", F.col("j").alias("k"), F.col("v").alias("a")).join(x.select("blk", F.col("i").alias("k"), F.col("v").alias("b")), ["blk", "k"])
    return met.groupBy("blk", "i").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def residual(a: Matrix, x: Vector, b: Vector) -> Vector:
    same_length(b, Vector(b.df, a.nrows))
    return add(b, mult(a, x), 1, -1)
