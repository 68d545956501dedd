"""Assembly of triplets, storage forms and conversions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matrel.relation import Matrix, Vector

RANGES = {"tinyint": (-(2**7), 2**7 - 1), "smallint": (-(2**15), 2**15 - 1), "int": (-(2**31), 2**31 - 1), "bigint": (-(2**63), 2**63 - 1)}


def insert(a: Matrix, triplets: DataFrame) -> Matrix:
    """Triplets appended; duplicates are legal until ``compress``."""
    return replace(a, df=a.df.unionByName(triplets.select("i", "j", F.col("v").cast(a.dtype).alias("v"))))


def sort(a: Matrix) -> Matrix:
    """Ordered by row, then column."""
    return replace(a, df=a.df.orderBy("i", "j"))


def compress(a: Matrix) -> Matrix:
    """Duplicates summed; zeros that result stay stored."""
    return replace(a, df=a.df.groupBy("i", "j").agg(F.sum("v").cast(a.dtype).alias("v")))


def insert_last(triplets: DataFrame, nrows: int, ncols: int, order: str = "seq") -> Matrix:
    """Assembly where the last insertion of an entry wins; ``order`` is the insertion's number (of equal ones the larger value stands)."""
    return Matrix(triplets.groupBy("i", "j").agg(F.max_by("v", F.struct(order, "v")).alias("v")), nrows, ncols)


def insert_plus(triplets: DataFrame, nrows: int, ncols: int) -> Matrix:
    """Assembly where insertions add up."""
    kind = triplets.schema["v"].dataType
    return Matrix(triplets.groupBy("i", "j").agg(F.sum("v").cast(kind).alias("v")), nrows, ncols)


def insert_with(triplets: DataFrame, nrows: int, ncols: int, update: Callable[[Column, Column], Column], start: Column, order: str = "seq") -> Matrix:
    """Assembly with an updater of one's own: ``update(old, new)`` folded in insertion order, from ``start``."""
    rows = triplets.groupBy("i", "j").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("s"), "v"))).alias("r"))
    return Matrix(rows.select("i", "j", F.aggregate("r", start, lambda s, x: update(s, x["v"])).alias("v")), nrows, ncols)


def shifted(triplets: DataFrame, rows: int, cols: int) -> DataFrame:
    """Triplets moved by an offset, for block assembly."""
    return triplets.withColumns({"i": F.col("i") + rows, "j": F.col("j") + cols})


def vector_insert(pairs: DataFrame, n: int, plus: bool = False, order: str = "seq") -> Vector:
    """A sparse vector from insertions: the last one wins, or they add up."""
    kind = pairs.schema["v"].dataType
    value = F.sum("v").cast(kind) if plus else F.max_by("v", F.struct(order, "v"))
    return Vector(pairs.groupBy("i").agg(value.alias("v")), n)


def exists(x: Vector, indices: DataFrame) -> DataFrame:
    """For each ``i`` of ``indices`` whether it is stored."""
    return indices.join(x.df.select("i", F.lit(True).alias("found")), "i", "left").select("i", F.coalesce("found", F.lit(False)).alias("found"))


def crop(x: Vector, threshold: float) -> Vector:
    """Entries of at least ``threshold`` in magnitude."""
    return replace(x, df=x.df.where(F.abs("v") >= threshold))


def crop_matrix(a: Matrix, threshold: float) -> Matrix:
    return a.where(F.abs("v") >= threshold)


def lookup_vector(x: Vector, indices: DataFrame) -> DataFrame:
    """Values at ``indices`` (column ``i``), 0 where absent."""
    return indices.join(x.df, "i", "left").select("i", F.coalesce("v", F.lit(0).cast(x.dtype)).alias("v"))


def lookup(a: Matrix, places: DataFrame) -> DataFrame:
    """Values at ``places`` (columns ``i, j``), 0 where absent."""
    return places.join(a.df, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0).cast(a.dtype)).alias("v"))


def to_ell(a: Matrix) -> DataFrame:
    """Rows of equal width ``i, idx, val``: the widest row's, padded with -1 and 0."""
    packed = a.df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    width = packed.agg(F.coalesce(F.max(F.size("r")), F.lit(0)).alias("width"))
    padded = packed.crossJoin(F.broadcast(width))  # one row
    pad = lambda c, x: F.concat(F.col(c), F.array_repeat(x, F.col("width") - F.size(c)))
    flat = padded.select("i", "width", F.col("r.j").alias("idx"), F.col("r.v").alias("val"))
    return flat.select("i", pad("idx", F.lit(-1).cast("long")).alias("idx"), pad("val", F.lit(0).cast(a.dtype)).alias("val"))


def from_ell(df: DataFrame, nrows: int, ncols: int) -> Matrix:
    flat = df.select("i", F.inline(F.arrays_zip(F.col("idx").alias("j"), F.col("val").alias("v"))).alias("j", "v"))
    return Matrix(flat.where("j >= 0"), nrows, ncols)


def to_csc(a: Matrix) -> DataFrame:
    """Compressed columns ``j, idx, val``, rows ascending."""
    packed = a.df.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("r"))
    return packed.select("j", F.col("r.i").alias("idx"), F.col("r.v").alias("val"))


def from_csc(df: DataFrame, nrows: int, ncols: int) -> Matrix:
    flat = df.select("j", F.inline(F.arrays_zip(F.col("idx").alias("i"), F.col("val").alias("v"))).alias("i", "v"))
    return Matrix(flat.select("i", "j", "v"), nrows, ncols)


def transpose_csc(df: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """The transpose of compressed columns, as compressed columns."""
    a = from_csc(df, nrows, ncols)
    return to_csc(Matrix(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), ncols, nrows))


def block_diagonal(blocks: DataFrame, sizes: DataFrame) -> Matrix:
    """Dense blocks ``blk, i, j, v`` along the diagonal; ``sizes`` has ``blk, n``. Offsets are running sums over the list of blocks."""
    ahead = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("blk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("at"))
    total = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    placed = blocks.join(at, "blk")
    return Matrix(placed.select((F.col("i") + F.col("at")).alias("i"), (F.col("j") + F.col("at")).alias("j"), "v"), total, total)


def identity(spark: SparkSession, n: int, kind: str = "double") -> Matrix:
    return Matrix(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1).cast(kind).alias("v")), n, n)


def unit_vector(spark: SparkSession, n: int, k: int, kind: str = "double") -> Vector:
    """Zero but for a 1 at ``k``; all entries stored."""
    if not 0 <= k < n:
        raise IndexError(f"{k} isn't in 0..{n - 1}")
    return Vector(spark.range(n).select(F.col("id").alias("i"), F.when(F.col("id") == k, 1).otherwise(0).cast(kind).alias("v")), n)


def diagonal(a: Matrix) -> Vector:
    """The diagonal as a vector, zeros stored."""
    n = min(a.shape)
    return Vector(a.df.where("i = j").select("i", "v"), n).dense()


def diag(x: Vector) -> Matrix:
    """A vector as a diagonal matrix."""
    return Matrix(x.df.select("i", F.col("i").alias("j"), "v"), x.n, x.n)


def convert(a: Matrix | Vector, kind: str) -> Matrix | Vector:
    """Elements cast to another type; a value that doesn't fit raises."""
    return a.map(lambda v: v.cast(kind))


def saturating(v: Column, kind: str) -> Column:
    """A value as an integral type: cut towards zero, clamped to its range, NaN to 0; other types are cast."""
    if kind not in RANGES:
        return v.cast(kind)
    low, high = RANGES[kind]
    d = v.cast("double")
    cut = F.when(d >= 0, F.floor(d)).otherwise(F.ceil(d))
    return F.when(v.isNull(), None).when(F.isnan(d), F.lit(0).cast(kind)).when(d <= float(low), F.lit(low).cast(kind)).when(d >= float(high), F.lit(high).cast(kind)).otherwise(cut).cast(kind)


def project_onto(a: Matrix | Vector, kind: str, scale: float | None = None) -> Matrix | Vector:
    """To a narrower type: a cast, or with a scale ``v * scale`` saturated."""
    return convert(a, kind) if scale is None else a.map(lambda v: saturating(v * F.lit(scale), kind))


def embed_into(a: Matrix | Vector, kind: str, scale: float | None = None) -> Matrix | Vector:
    """To a wider type, times a scale if there is one."""
    return a.map(lambda v: v.cast(kind) if scale is None else v.cast(kind) * F.lit(scale).cast(kind))


def fill(a: Matrix | Vector, value: float) -> Matrix | Vector:
    """Every element set to ``value``."""
    return a.dense().map(lambda v: F.lit(value).cast(a.dtype))


def set_to_zero(a: Matrix | Vector) -> Matrix | Vector:
    return fill(a, 0)


def random_vector(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Vector:
    """Uniform in [low, high), by a seed."""
    return Vector(spark.range(n).select(F.col("id").alias("i"), (F.rand(seed) * (high - low) + low).alias("v")), n)


def random_matrix(spark: SparkSession, nrows: int, ncols: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Matrix:
    grid = spark.range(nrows * ncols)
    return Matrix(grid.select(F.expr(f"id div {ncols}").alias("i"), (F.col("id") % ncols).alias("j"), (F.rand(seed) * (high - low) + low).alias("v")), nrows, ncols)


def fill_random(a: Matrix | Vector, low: float = 0.0, high: float = 1.0, seed: int = 0) -> Matrix | Vector:
    spark = a.df.sparkSession
    return random_vector(spark, a.n, low, high, seed) if isinstance(a, Vector) else random_matrix(spark, a.nrows, a.ncols, low, high, seed)


def change_dim(a: Matrix, nrows: int, ncols: int) -> Matrix:
    """Other dimensions; entries outside go."""
    return Matrix(a.df.where((F.col("i") < nrows) & (F.col("j") < ncols)), nrows, ncols)


def change_length(x: Vector, n: int) -> Vector:
    return Vector(x.df.where(F.col("i") < n), n)


def shape_of(a: Matrix | Vector) -> DataFrame:
    """Dimensions and size as one row."""
    rows, cols = (a.n, 1) if isinstance(a, Vector) else a.shape
    return a.df.sparkSession.range(1).select(F.lit(rows).cast("long").alias("num_rows"), F.lit(cols).cast("long").alias("num_cols"), F.lit(rows * cols).cast("long").alias("size"))


def as_vector(df: DataFrame, n: int) -> Vector:
    """A one-dimensional array ``d0, v`` as a vector."""
    return Vector(df.select(F.col("d0").alias("i"), "v"), n)


def as_matrix(df: DataFrame, nrows: int, ncols: int) -> Matrix:
    """A two-dimensional array ``d0, d1, v`` as a matrix."""
    return Matrix(df.select(F.col("d0").alias("i"), F.col("d1").alias("j"), "v"), nrows, ncols)


def as_ndarray(a: Matrix | Vector) -> DataFrame:
    names = ["d0"] if isinstance(a, Vector) else ["d0", "d1"]
    return a.dense().df.toDF(*names, "v")
