"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors whose cosine reaches t lie within epsilon = sqrt(2 - 2t) of each other, and so do their
projections on the leading principal axes. The vectors are sorted by their grid cells of width
epsilon there and cut into blocks, intervals of that order. Two blocks are joined only if their boxes are
within epsilon; a join halves its intervals again and again, leaves out pairs of intervals that are provably
distant, and multiplies what is left. The axes only steer what is left out: they may come from a
bounded sample, the result is exact.

A block pair returns a count a vector and a spanning forest of its links, never the links themselves, so a dense
group of near copies gives rows in proportion to its blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.llm import _words
from matrel.llm._io import table, written
from matrel.llm.components import components, roots

#: Vectors the axes are fitted on (those with the least hashes); bounds what the driver reads.
SAMPLE = 4000
#: Axes whose projections make the boxes. Vectors in a block: blocks are moved in pairs, so larger ones move each vector less often; an
#: interval that is multiplied whole.
AXES = 8
BLOCK = 2048
LEAF = 256
#: Axes whose cells are looked up to find the partners of a block.
_LOOKED_UP = 2


def _usable(docs: DataFrame, vector: str, label: str, key: str) -> DataFrame:
    """Rows ``id, label, dim, digest, raw``: vectors that can be linked, as packed doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(2).cast(pa.large_list(pa.float64()))
            off, flat = column.offsets.to_numpy(), column.values
            value = flat.fill_null(np.nan).to_numpy(zero_copy_only=False)
            upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])[off]
            size = np.diff(off)
            usable = (size > 0) & (np.diff(upto(np.isfinite(value))) == size) & (np.diff(upto(value != 0)) > 0)
            rows = np.flatnonzero(usable & column.is_valid().to_numpy(zero_copy_only=False))
            # what the chosen rows hold, one behind the other
            ends = np.concatenate([[0], np.cumsum(size[rows])])
            held = value[np.repeat(off[rows] - ends[:-1], size[rows]) + np.arange(ends[-1])]
            raw = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer((8 * ends).astype(np.int64)), pa.py_buffer(held)])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(size[rows].astype(np.int32)), raw.cast(pa.binary())], names=["id", "label", "dim", "raw"])

    rows = docs.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    out = rows.mapInArrow(_words.tidy(run), f"id {kinds['id']}, label {kinds['label']}, dim int, raw binary")
    return out.select("id", "label", "dim", F.unhex(F.sha2("raw", 256)).alias("digest"), "raw")


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of a binary column, one row behind the other."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and column.buffers()[2] is not None else np.zeros(0, np.uint8)


def _units(raws: list[bytes] | np.ndarray, n: int = 0) -> np.ndarray:
    """Packed vectors (a list, or the bytes of ``n`` of them) as rows of length 1."""
    x = np.frombuffer(b"".join(raws) if isinstance(raws, list) else raws.tobytes(), np.float64).reshape(n or len(raws), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension met in the sample, its leading principal axes."""
    rows = vectors.select("dim", "raw", F.xxhash64("digest").alias("h")).orderBy("h").limit(SAMPLE).collect()
    out = {}
    for dim in {r["dim"] for r in rows}:
        x = _units([r["raw"] for r in rows if r["dim"] == dim])
        _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        out[dim] = np.ascontiguousarray(axes[:AXES].T)
    return out


def _projected(units: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Projections (n x AXES); a dimension the sample didn't meet uses its first coordinates."""
    dim = units.shape[1]
    a = axes.get(dim)
    p = units @ a if a is not None else units[:, :AXES]
    return np.pad(p, ((0, 0), (0, AXES - p.shape[1])))


def _blocks(reps: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    """Blocks of the grid order: ``label, dim, block, c0_low .. c1_high, low, high (arrays), ids, copies, raws``."""
    kinds = {f.name: f.dataType.simpleString() for f in reps.schema.fields}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, AXES), np.int32)
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                cells[rows] = np.floor(_projected(_units(_bytes(batch.column(4).take(pa.array(rows))), len(rows)), axes) / epsilon)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(cells[:, k]) for k in range(AXES)]], names=[*batch.schema.names, *[f"c{k}" for k in range(AXES)]])

    schema = f"id {kinds['id']}, label {kinds['label']}, dim int, copies long, raw binary"
    cells = [f"c{k}" for k in range(AXES)]
    placed = reps.select("id", "label", "dim", "copies", "raw").mapInArrow(_words.tidy(place), schema + "".join(f", {c} int" for c in cells))
    order = ["label", "dim", *cells, "id"]
    # Whole cells may hold any share of the rows: the id in the key lets a range end within one.
    parts = max(1, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = written(placed, "placed").repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            ids, raw = rows.column(0).chunk(0), rows.column(4).chunk(0)
            p = _projected(_units(_bytes(raw), len(ids)), axes)
            c = np.stack([rows.column(5 + k).to_numpy() for k in range(_LOOKED_UP)], 1)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            cells = [pa.array([int(f(c[:, k]))], pa.int32()) for k in range(_LOOKED_UP) for f in (np.min, np.max)]
            edges = [pa.array([f(axis=0).tolist()], pa.list_(pa.float64())) for f in (p.min, p.max)]
            columns = [rows.column(1).chunk(0)[:1], rows.column(2).chunk(0)[:1], ids[:1], *cells, *edges, listed(ids), listed(rows.column(3).chunk(0)), pa.array([_bytes(raw).tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["label", "dim", "block", "c0_low", "c0_high", "c1_low", "c1_high", "low", "high", "ids", "copies", "raws"])

        last, n = None, 0
        for batch in batches:
            labels, dims = batch.column(1), batch.column(2)
            other = pc.or_(pc.not_equal(labels[1:], labels[:-1]), pc.not_equal(dims[1:], dims[:-1])) if batch.num_rows > 1 else pa.array([], pa.bool_())
            edges = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for start, end in pairwise(edges):
                own = (labels[start].as_py(), dims[start].as_py())
                while start < end:
                    if n and (own != last or n >= BLOCK):
                        yield block()
                        held, n = [], 0
                    last, some = own, min(end - start, BLOCK - n)
                    held.append(batch.slice(start, some))
                    n, start = n + some, start + some
        if n:
            yield block()

    return ordered.mapInArrow(_words.tidy(cut), f"label {kinds['label']}, dim int, block {kinds['id']}, c0_low int, c0_high int, c1_low int, c1_high int, low array<double>, high array<double>, ids array<{kinds['id']}>, copies array<long>, raws binary")


def _near_blocks(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks (each once, a block with itself too) whose boxes are within epsilon; no vectors are moved for it."""
    box = blocks.select("label", "dim", "block", "c0_low", "c0_high", "c1_low", "c1_high", "low", "high")

    def side(x: str, reach: int) -> DataFrame:
        out = box.select("label", "dim", *[F.col(c).alias(f"{c}_{x}") for c in box.columns[2:]], F.explode(F.sequence(F.col("c0_low") - reach, F.col("c0_high") + reach)).alias("c0"))
        return out.withColumn("c1", F.explode(F.sequence(F.col(f"c1_low_{x}") - reach, F.col(f"c1_high_{x}") + reach)))

    met = side("a", 0).join(side("b", 1), ["label", "dim", "c0", "c1"]).where("block_a <= block_b")
    for c in ("c0", "c1"):  # a pair that meets in several cells counts in the first
        met = met.where(F.col(c) == F.greatest(F.col(f"{c}_low_a"), F.col(f"{c}_low_b") - 1))
    gaps = F.zip_with(F.arrays_zip("low_a", "high_a"), F.arrays_zip("low_b", "high_b"), lambda x, y: F.greatest(F.lit(0.0), x["low_a"] - y["high_b"], y["low_b"] - x["high_a"]))
    met = met.where(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g) <= epsilon * epsilon)
    return met.select("label", "dim", "block_a", "block_b")


class _Join:
    """The recursive join of two blocks."""

    def __init__(self, a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, threshold: float, epsilon: float):
        self.a, self.b, self.p, self.q = a, b, p, q
        self.threshold, self.reach = threshold, epsilon * epsilon
        self.rows: list[np.ndarray] = []
        self.cols: list[np.ndarray] = []
        self.go(0, len(a), 0, len(b))

    def go(self, i: int, j: int, k: int, m: int) -> None:
        gap = np.maximum(0, np.maximum(self.p[i:j].min(0) - self.q[k:m].max(0), self.q[k:m].min(0) - self.p[i:j].max(0)))
        if gap @ gap > self.reach:
            return
        if j - i <= LEAF and m - k <= LEAF:
            r, c = np.nonzero(self.a[i:j] @ self.b[k:m].T >= self.threshold)
            self.rows.append(r + i)
            self.cols.append(c + k)
        elif j - i >= m - k:
            half = (i + j) // 2
            self.go(i, half, k, m)
            self.go(half, j, k, m)
        else:
            half = (k + m) // 2
            self.go(i, j, k, half)
            self.go(i, j, half, m)


def near_vectors(docs: DataFrame, threshold: float = 0.93, vector: str = "embedding", label: str = "label", key: str = "vec_id") -> DataFrame:
    """Rows ``key, n_links, component_id, kept``, one for each row of ``docs``.

    Two vectors are linked if their labels are equal and not null, they have the same dimension and their cosine, in
    double precision, is at least ``threshold`` (over 0). Vectors that are null, empty or zero, or hold null or
    non-finite components, and rows with a null label or key link with nothing: 0 links, their own key as component
    (null for a null key), kept. Equal vectors link like any others. Rows that share a key are one node and their links
    add up. An empty table gives an empty one; further columns are ignored, whatever their names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    epsilon = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-7
    usable = written(_usable(docs, vector, label, key), "vectors")
    axes = principal_axes(usable)
    classes = written(usable.groupBy("label", "digest").agg(F.min("id").alias("rep"), F.count("id").alias("copies")), "classes")
    reps = usable.join(classes, (usable["label"] == classes["label"]) & (usable["digest"] == classes["digest"]) & (usable["id"] == classes["rep"]), "inner").select(usable["id"], usable["label"], "dim", "copies", "raw").dropDuplicates(["label", "id", "raw"])
    blocks = written(_blocks(reps, axes, epsilon), "blocks", heavy=True)
    pairs = written(_near_blocks(blocks, epsilon), "pairs")
    id_kind = usable.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids_a, ids_b, copies_a, copies_b = (batch.column(c)[k].values for c in (1, 2, 3, 4))
                a, b = (_units(np.frombuffer(batch.column(c)[k].as_buffer(), np.uint8), len(ids)) for c, ids in ((5, ids_a), (6, ids_b)))
                found = _Join(a, b, _projected(a, axes), _projected(b, axes), threshold, epsilon)
                rows, cols = (np.concatenate(x) if x else np.zeros(0, int) for x in (found.rows, found.cols))
                names, at = np.unique(np.concatenate([ids_a.to_numpy(zero_copy_only=False), ids_b.to_numpy(zero_copy_only=False)]), return_inverse=True)
                x, y = at[: len(ids_a)], at[len(ids_a) :]
                other = x[rows] != y[cols]
                rows, cols = rows[other], cols[other]
                n = np.zeros(len(names), np.int64)
                np.add.at(n, x[rows], copies_b.to_numpy()[cols])
                if not batch.column(0)[k].as_py():
                    np.add.at(n, y[cols], copies_a.to_numpy()[rows])
                root = roots(len(names), x[rows], y[cols])
                hit = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(names[hit], ids_a.type), pa.array(n[hit]), pa.array(names[root[hit]], ids_a.type)], names=["id", "n", "root"])

    # A block with itself must see both orders of each pair, which the full product gives.
    side = lambda x: blocks.select("label", "dim", F.col("block").alias(f"block_{x}"), F.col("ids").alias(f"ids_{x}"), F.col("copies").alias(f"copies_{x}"), F.col("raws").alias(f"raws_{x}"))
    both = pairs.join(side("a"), ["label", "dim", "block_a"]).join(side("b"), ["label", "dim", "block_b"])
    both = both.select((F.col("block_a") == F.col("block_b")).alias("same"), "ids_a", "ids_b", "copies_a", "copies_b", "raws_a", "raws_b")
    found = written(both.mapInArrow(_words.tidy(run), f"id {id_kind}, n long, root {id_kind}"), "found", heavy=True)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(usable.join(classes.where("copies > 1"), ["label", "digest"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))))
    members = usable.select("id", "label", "digest").join(classes, ["label", "digest"]).select("id", "rep", "copies")
    linked = members.join(counts.withColumnRenamed("id", "rep"), "rep", "left").groupBy("id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = docs.select(F.col(key).alias("id")).join(linked, "id", "left").join(groups, "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
