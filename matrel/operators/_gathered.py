"""Products of sparse matrices of whole numbers whose terms are formed and summed in the tasks that hold both factors' entries.

Rows of the result are cut into groups, and so are its columns, by how many entries they hold. Of each contraction index, a pair of groups gets the
entries of its rows and those of its columns, packed: an entry is moved at most once for each group of the other side, not once for each entry
it meets. A task multiplies one pair, row by row, so nothing is sorted or spilled and no place has partial sums elsewhere.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matrel.relation import Matrix

#: Entries a group holds at most, groups there are at least (as pairs of groups are the tasks), buckets of indices that are counted to cut the groups.
HELD, GROUPS, BUCKETS = 8 << 20, 8, 1 << 16
#: Entries packed at once, terms and places at once, and places for each term up to which sums are formed in an array of all places.
PACKED, TERMS, SPARSE = 1 << 20, 1 << 20, 16

_HEAD = struct.Struct("<qqBBB")


@dataclass(frozen=True)
class Groups:
    """Where groups of indices start, how many entries they have in all, and the largest sum of magnitudes of a bucket."""

    starts: np.ndarray
    n: int
    total: float


def groups(df: DataFrame, index: str, inner: str, length: int) -> Groups | None:
    """Groups of ``index`` of at most ``HELD`` entries. None where an entry has no value or is out of place, or near indices have too many entries for a group."""
    width = -(-length // BUCKETS)
    odd = F.col(index).isNull() | F.col("v").isNull() | (F.col(index) < 0) | (F.col(index) >= length)
    counted = df.where(F.col(inner).isNotNull()).groupBy(F.expr(f"{index} div {width}").alias("b"))
    rows = counted.agg(F.count("*").alias("n"), F.sum(F.abs(F.col("v").cast("double"))).alias("total"), F.max(odd).alias("odd")).collect()
    if any(r["odd"] or r["n"] > HELD for r in rows):
        return None
    rows = sorted((r["b"], r["n"], r["total"]) for r in rows)
    n = sum(r[1] for r in rows)
    if not n:
        return Groups(np.zeros(1, np.int64), 0, 0.0)
    target = max(1, min(HELD, -(-n // GROUPS)))
    starts, held = [0], 0
    for b, k, _ in rows:
        if held and held + k > target:
            starts.append(b * width)
            held = 0
        held += k
    return Groups(np.asarray(starts, np.int64), n, max(r[2] for r in rows))


def product(a: Matrix, b: Matrix, rows: Groups, columns: Groups, same: bool) -> Matrix:
    """``A B``, of entries that have values and places. ``same``: B is A transposed, so pairs of groups are multiplied once for both triangles."""
    kept = a.df.select(F.col("j").cast("bigint").alias("k"), F.col("i").cast("bigint").alias("p"), "v", F.lit(0).cast("tinyint").alias("side"))
    if not same:
        kept = kept.unionByName(b.df.select(F.col("i").cast("bigint").alias("k"), F.col("j").cast("bigint").alias("p"), "v", F.lit(1).cast("tinyint").alias("side")))
    starts = (rows.starts, columns.starts)
    packed = kept.where("k is not null").repartition("k").sortWithinPartitions("k").mapInArrow(_packing(starts, same), "g int, side tinyint, entries binary")
    ends = (np.append(rows.starts[1:], a.nrows), np.append(columns.starts[1:], b.ncols))
    met = packed.repartitionById(len(_pairs(starts, same)), "g")
    return Matrix(met.mapInArrow(_multiplying(starts, ends, same), "i long, j long, v long"), a.nrows, b.ncols)


def _pairs(starts: tuple[np.ndarray, np.ndarray], same: bool) -> list[tuple[int, int]]:
    """The pairs of groups that are multiplied; a pair's place in the list is the partition it goes to."""
    return [(r, c) for r in range(len(starts[0])) for c in range(r if same else 0, len(starts[1]))]


def _narrow(x: np.ndarray) -> np.ndarray:
    lo, hi = int(x.min()), int(x.max())
    kind = next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= lo and hi <= np.iinfo(t).max)
    return x.astype(kind)


def encoded(k: np.ndarray, p: np.ndarray, v: np.ndarray) -> bytes:
    """Entries by ascending ``k``: differences and numbers in as few bytes as hold all, byte by byte, compressed."""
    parts = [_narrow(x) for x in (np.diff(k, prepend=k[:1]), p, v)]
    planes = b"".join(x.view(np.uint8).reshape(len(x), -1).T.tobytes() for x in parts)
    return _HEAD.pack(len(k), int(k[0]), *(x.itemsize for x in parts)) + zlib.compress(planes, 1)


def decoded(entries: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, first, *sizes = _HEAD.unpack_from(entries)
    flat, at, out = np.frombuffer(zlib.decompress(memoryview(entries)[_HEAD.size :]), np.uint8), 0, []
    for size in sizes:
        out.append(np.ascontiguousarray(flat[at : at + n * size].reshape(size, n).T).view(f"i{size}")[:, 0])
        at += n * size
    return np.cumsum(out[0], dtype=np.int64) + first, out[1], out[2]


def _packing(starts: tuple[np.ndarray, np.ndarray], same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    left, right = len(starts[0]), len(starts[1])
    pair = {rc: g for g, rc in enumerate(_pairs(starts, same))}
    size = min(PACKED, max(1 << 14, (1 << 25) // max(left, right)))

    def packed(held: list[list[np.ndarray]]) -> Iterator[tuple[int, int, bytes]]:
        k, p, v, side = (np.concatenate(c) for c in zip(*held, strict=True))
        number = np.cumsum(np.diff(k, prepend=k[:1]) != 0)
        of = [np.flatnonzero(side == s) for s in (0, 1)]
        group = [np.searchsorted(starts[s], p[of[s]], side="right") - 1 for s in (0, 1)]
        has = [np.zeros((number[-1] + 1, len(starts[s])), bool) for s in (0, 1)]
        for s in (0, 1):
            has[s][number[of[s]], group[s]] = True
            has[s][[0, -1]] = True  # the first and the last index may go on in other parts
        for s in (0, 1):
            order = np.argsort(group[s], kind="stable")
            bounds = np.searchsorted(group[s][order], np.arange(len(starts[s]) + 1))
            for g in range(len(starts[s])):
                mine = of[s][order[bounds[g] : bounds[g + 1]]]
                if not len(mine):
                    continue
                meets = has[0 if same else 1 - s][number[mine]]
                for other in range(g if same else 0, left if s else right):
                    at = mine[meets[:, other]]
                    if len(at):
                        yield pair[(other, g) if s else (g, other)], s, encoded(k[at], p[at] - starts[s][g], v[at])
                if same:  # also the columns of the groups before
                    for other in range(g):
                        at = mine[meets[:, other]]
                        if len(at):
                            yield pair[other, g], 1, encoded(k[at], p[at] - starts[0][g], v[at])

    def batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        g, side, entries = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(side, pa.int8()), pa.array(entries, pa.binary())], names=["g", "side", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def all_packed(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            rows: list[tuple[int, int, bytes]] = []
            n = 0
            for row in packed(held):
                rows.append(row)
                n += len(row[2])
                if n >= 1 << 22:
                    yield batch(rows)
                    rows, n = [], 0
            if rows:
                yield batch(rows)

        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            if b.num_rows:
                held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
                n += b.num_rows
            if n >= size:
                yield from all_packed(held)
                held, n = [], 0
        if n:
            yield from all_packed(held)

    return run


def _gathered(parts: list[bytes]) -> list[np.ndarray]:
    """The entries of all parts; contraction indices in 32 bits if they fit."""
    out: list[list[np.ndarray]] = [[], [], []]
    for entries in parts:
        k, p, v = decoded(entries)
        for held, x in zip(out, (k.astype(np.int32) if k[-1] < 2**31 and k[0] >= -(2**31) else k, p, v), strict=True):
            held.append(x)
    parts.clear()
    return [np.concatenate(x) for x in out]


def _multiplying(starts: tuple[np.ndarray, np.ndarray], ends: tuple[np.ndarray, np.ndarray], same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    pairs = _pairs(starts, same)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], list[bytes]]] = {}
        for b in batches:
            for g, side, entries in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.setdefault(g, ([], []))[side].append(entries)
        while held:
            g, (x, y) = held.popitem()
            r, c = pairs[g]
            if not x or not (y or (same and r == c)):
                continue
            rows = _gathered(x)
            columns = rows if same and r == c else _gathered(y)
            for p, q, v in multiplied(rows, columns, int(ends[1][c] - starts[1][c])):
                i, j, values = pa.array(p + starts[0][r]), pa.array(q + starts[1][c]), pa.array(v)
                yield pa.RecordBatch.from_arrays([i, j, values], names=["i", "j", "v"])
                if same and r != c:
                    yield pa.RecordBatch.from_arrays([j, i, values], names=["i", "j", "v"])

    return run


def multiplied(rows: list[np.ndarray], columns: list[np.ndarray], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and sums, some rows at a time, of entries ``k, p, v`` and ``k, q, v`` with ``0 <= q < width``."""
    order = np.argsort(columns[0], kind="stable")
    rk, rq, rv = (x[order] for x in columns)
    first = np.flatnonzero(np.append(True, rk[1:] != rk[:-1])).astype(np.int32)
    keys, lengths = rk[first], np.diff(np.append(first, len(rk)).astype(np.int32))
    del order, rk
    lk, lp, lv = rows
    at = np.minimum(np.searchsorted(keys, lk), len(keys) - 1).astype(np.int32)
    order = np.flatnonzero(keys[at] == lk)
    order = order[np.argsort(lp[order], kind="stable")]
    if not len(order):
        return
    at, lp, lv = at[order], lp[order], lv[order]
    del order, lk
    begin, n = first[at], lengths[at]
    del at
    changed = np.append(np.flatnonzero(np.append(True, lp[1:] != lp[:-1])), len(lp))  # where rows start
    terms = np.append(0, np.cumsum(n, dtype=np.int64)[changed[1:] - 1])  # before each row
    dense = (len(changed) - 1) * width <= SPARSE * int(terms[-1])
    most = max(1, TERMS // width) if dense else len(changed)
    row = 0
    while row < len(changed) - 1:
        stop = min(max(row + 1, int(np.searchsorted(terms, terms[row] + TERMS, side="right")) - 1), row + most, len(changed) - 1)
        places, sums = (_dense if dense else _sparse)(changed[row : stop + 1], begin, n, lv, rq, rv, width)
        local = places // width
        yield lp[changed[row:stop]][local].astype(np.int64), places - local * width, sums
        row = stop


def _terms(u: int, w: int, base: np.ndarray, begin: np.ndarray, n: np.ndarray, lv: np.ndarray, rq: np.ndarray, rv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the terms of the entries u..w, whose rows begin at the places ``base``."""
    many = n[u:w]
    before = np.cumsum(many, dtype=np.int64) - many
    at = np.arange(before[-1] + many[-1]) + np.repeat(begin[u:w] - before, many)
    return np.repeat(base, many) + rq[at], np.repeat(lv[u:w].astype(np.int64), many) * rv[at]


def _dense(changed: np.ndarray, begin: np.ndarray, n: np.ndarray, lv: np.ndarray, rq: np.ndarray, rv: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    places = (len(changed) - 1) * width
    sums, touched = np.zeros(places, np.int64), np.zeros(places, bool)
    base = np.repeat(np.arange(len(changed) - 1) * width, np.diff(changed))
    start, end = int(changed[0]), int(changed[-1])
    done = np.cumsum(n[start:end], dtype=np.int64)
    u = 0
    while u < end - start:  # one row may have more terms than are formed at once
        w = max(u + 1, int(np.searchsorted(done, (done[u - 1] if u else 0) + 2 * TERMS, side="right")))
        place, value = _terms(start + u, start + w, base[u:w], begin, n, lv, rq, rv)
        np.add.at(sums, place, value)
        touched[place] = True
        u = w
    at = np.flatnonzero(touched)
    return at, sums[at]


def _sparse(changed: np.ndarray, begin: np.ndarray, n: np.ndarray, lv: np.ndarray, rq: np.ndarray, rv: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    base = np.repeat(np.arange(len(changed) - 1) * width, np.diff(changed))
    place, value = _terms(int(changed[0]), int(changed[-1]), base, begin, n, lv, rq, rv)
    order = np.argsort(place, kind="stable")
    place = place[order]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[first], np.add.reduceat(value[order], first)
