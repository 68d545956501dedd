"""What iterative solvers need of an operator: ``A x`` and ``A^H x`` on NumPy vectors, wherever A lives.

``Local`` keeps a small matrix as compressed rows in memory; ``Distributed`` keeps it as a cached relation and runs a Spark job a product. The
work vectors of a solver have one number a row and stay with the loop on the driver; ``choose`` takes the local form only for matrices
of a checked size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

from matrel.relation import Matrix

#: Stored entries up to which a matrix is brought into memory.
LOCAL_ENTRIES = 2_000_000
#: Numbers in a work vector at most: 400 MB.
VECTOR_ENTRIES = 50_000_000


class Csr:
    """Compressed rows in NumPy."""

    def __init__(self, n: int, m: int, rows: np.ndarray, cols: np.ndarray, values: np.ndarray):
        order = np.lexsort((cols, rows))
        rows, cols, values = rows[order], cols[order], values[order]
        if len(rows):
            lead = np.concatenate([[True], (rows[1:] != rows[:-1]) | (cols[1:] != cols[:-1])])
            at = np.flatnonzero(lead)
            values = np.add.reduceat(values, at)
            rows, cols = rows[at], cols[at]
        self.shape = (n, m)
        self.ptr = np.searchsorted(rows, np.arange(n + 1))
        self.rows, self.idx, self.val = rows, cols, values

    @classmethod
    def from_dense(cls, a: np.ndarray) -> Csr:
        r, c = np.nonzero(a)
        return cls(*a.shape, r, c, a[r, c])

    def dense(self) -> np.ndarray:
        out = np.zeros(self.shape, self.val.dtype)
        out[self.rows, self.idx] = self.val
        return out

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ptr[i], self.ptr[i + 1]
        return self.idx[a:b], self.val[a:b]

    def transpose(self) -> Csr:
        return Csr(self.shape[1], self.shape[0], self.idx, self.rows, self.val)

    def permuted(self, p: np.ndarray | None, q: np.ndarray | None) -> Csr:
        """Row k of the result is row ``p[k]``, column k is column ``q[k]``."""
        r, c = self.rows, self.idx
        if p is not None:
            inverse = np.empty(len(p), int)
            inverse[p] = np.arange(len(p))
            r = inverse[r]
        if q is not None:
            inverse = np.empty(len(q), int)
            inverse[q] = np.arange(len(q))
            c = inverse[c]
        return Csr(*self.shape, r, c, self.val)

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], *x.shape[1:]), np.result_type(self.val, x))
        np.add.at(out, self.rows, self.val.reshape(-1, *[1] * (x.ndim - 1)) * x[self.idx])
        return out

    def diagonal(self) -> np.ndarray:
        out = np.zeros(min(self.shape), self.val.dtype)
        on = self.rows == self.idx
        out[self.rows[on]] = self.val[on]
        return out


class Local:
    def __init__(self, a: Csr | np.ndarray):
        self.csr = a if isinstance(a, Csr) else Csr.from_dense(np.asarray(a))
        self.shape = self.csr.shape
        self._adjoint: Csr | None = None

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.csr @ x

    def adjoint(self, x: np.ndarray) -> np.ndarray:
        if self._adjoint is None:
            t = self.csr.transpose()
            t.val = t.val.conj()
            self._adjoint = t
        return self._adjoint @ x


class Distributed:
    """The relation stays on the executors; each product joins nothing: the vector (one number a row) is broadcast and partial sums come back.

    The vector must fit in a task's memory and in the driver's, as a solver's work vectors do: dimensions over ``VECTOR_ENTRIES`` are refused
    (``products.mult`` has no such bound, as both its sides are relations).
    """

    def __init__(self, a: Matrix):
        if max(a.shape) > VECTOR_ENTRIES:
            raise ValueError(f"work vectors of {max(a.shape)} numbers are over the bound of {VECTOR_ENTRIES}")
        self.shape = a.shape
        self.df = a.df.select("i", "j", F.col("v").cast("double").alias("v")).persist(StorageLevel.MEMORY_AND_DISK)

    def _product(self, x: np.ndarray, out: str, by: str, n: int) -> np.ndarray:
        held = self.df.sparkSession.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i, j, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
                rows, at = np.unique(i, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, v * held.value[j], len(rows)))], names=["i", "s"])

        got = self.df.select(out, by, "v").mapInArrow(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).toArrow()
        held.unpersist()
        y = np.zeros(n)
        y[got.column("i").to_numpy()] = got.column("s").to_numpy()
        return y

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self._product(x, "i", "j", self.shape[0])

    def adjoint(self, x: np.ndarray) -> np.ndarray:
        return self._product(x, "j", "i", self.shape[1])


class Function:
    """An operator given by functions."""

    def __init__(self, n: int, apply: Callable[[np.ndarray], np.ndarray], adjoint: Callable[[np.ndarray], np.ndarray] | None = None):
        self.shape = (n, n)
        self.apply = apply
        self.adjoint = adjoint or apply


def to_csr(a: Matrix, checked: bool = False) -> Csr:
    """The whole relation on the driver, as compressed rows. Unless its size is ``checked``, more than ten times ``LOCAL_ENTRIES`` entries are refused."""
    if not checked and a.size > 10 * LOCAL_ENTRIES and a.df.limit(10 * LOCAL_ENTRIES + 1).count() > 10 * LOCAL_ENTRIES:
        raise ValueError(f"more than {10 * LOCAL_ENTRIES} entries don't come to the driver")
    got = a.df.select("i", "j", "v").toArrow()
    v = got.column("v")
    if pa.types.is_struct(v.type):
        v = v.combine_chunks()
        values = v.field("re").to_numpy(zero_copy_only=False) + 1j * v.field("im").to_numpy(zero_copy_only=False)
    else:
        values = v.to_numpy().astype(float)
    return Csr(a.nrows, a.ncols, got.column("i").to_numpy(), got.column("j").to_numpy(), values)


def choose(a: Matrix | Csr | np.ndarray, entries: int = LOCAL_ENTRIES):
    """The local form up to ``entries`` stored entries, the distributed one beyond."""
    if not isinstance(a, Matrix):
        return a if hasattr(a, "apply") else Local(a)
    if a.df.limit(entries + 1).count() <= entries:
        return Local(to_csr(a, checked=True))
    return Distributed(a)
