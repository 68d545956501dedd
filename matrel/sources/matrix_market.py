"""Matrix Market files: coordinate or array, real or integer, general or symmetric, plain or gzipped.

Files are read by Spark's text source, so any path Spark knows will do and gzip is undone on the way. Only the banner and the size
line come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.relation import Matrix


class MatrixMarketError(ValueError):
    pass


def parse_banner(line: str) -> tuple[bool, bool]:
    """(coordinate, symmetric) of a banner line, or an error for what isn't supported."""
    parts = line.split()
    if len(parts) != 5 or parts[0] != "%%MatrixMarket" or parts[1] != "matrix":
        raise MatrixMarketError(f"no Matrix Market banner: {line!r}")
    layout, field, symmetry = parts[2:]
    if layout not in ("coordinate", "array"):
        raise MatrixMarketError(f"format {layout!r} isn't supported")
    if field not in ("real", "integer"):
        raise MatrixMarketError(f"field {field!r} isn't supported")
    if symmetry not in ("general", "symmetric"):
        raise MatrixMarketError(f"symmetry {symmetry!r} isn't supported")
    return layout == "coordinate", symmetry == "symmetric"


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """The file's lines with their order. A text file is read in order; the number only has to rise, and it does within and across its splits."""
    return spark.read.text(path).withColumn("at", F.monotonically_increasing_id())


def _open(spark: SparkSession, path: str) -> tuple[bool, bool, list[int], DataFrame]:
    lines = _numbered(spark, path)
    head = lines.orderBy("at").limit(1).collect()
    if not head:
        raise MatrixMarketError("the file is empty")
    coordinate, symmetric = parse_banner(head[0]["value"])
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    size = body.orderBy("at").limit(1).collect()
    if not size:
        raise MatrixMarketError("the size line is missing")
    try:
        numbers = [int(x) for x in size[0]["value"].split()]
    except ValueError as e:
        raise MatrixMarketError(f"bad size line {size[0]['value']!r}") from e
    if len(numbers) != (3 if coordinate else 2) or min(numbers) < 0:
        raise MatrixMarketError(f"bad size line {size[0]['value']!r}")
    if symmetric and numbers[0] != numbers[1]:
        raise MatrixMarketError("a symmetric matrix must be square")
    return coordinate, symmetric, numbers, body.where(F.col("at") > size[0]["at"])


def _triplets(spark: SparkSession, path: str) -> tuple[DataFrame, list[int]]:
    """``i, j, v, at`` from 0, mirrored where the file is symmetric, after range and count checks."""
    coordinate, symmetric, size, body = _open(spark, path)
    rows, cols = size[:2]
    words = F.split(F.trim("value"), r"\s+")
    if coordinate:
        t = body.select(F.try_element_at(words, F.lit(1)).try_cast("long").alias("i"), F.try_element_at(words, F.lit(2)).try_cast("long").alias("j"), F.try_element_at(words, F.lit(3)).try_cast("double").alias("v"), "at")
        t = t.withColumns({"i": F.col("i") - 1, "j": F.col("j") - 1})
    else:
        values = body.select(F.posexplode(words).alias("k", "w"), "at").select(F.col("w").try_cast("double").alias("v"), "at", "k")
        flat = values.rdd.map(lambda r: (r["at"], r["k"], r["v"])).sortBy(lambda r: r[:2]).zipWithIndex().map(lambda x: (x[1], x[0][2])).toDF("n long, v double")
        if symmetric:
            # columns of the lower triangle one after the other
            c = F.floor(((2 * rows + 1) - F.sqrt(F.lit(float((2 * rows + 1) ** 2)) - 8 * F.col("n"))) / 2).cast("long")
            flat = flat.withColumn("j", c)
            start = F.col("j") * rows - F.expr("j * (j - 1) div 2")
            t = flat.select((F.col("n") - start + F.col("j")).alias("i"), "j", "v", F.col("n").alias("at"))
        else:
            t = flat.select((F.col("n") % rows).alias("i"), F.expr(f"n div {rows}").alias("j"), "v", F.col("n").alias("at"))
    bad = F.col("i").isNull() | F.col("j").isNull() | F.col("v").isNull() | (F.col("i") < 0) | (F.col("i") >= rows) | (F.col("j") < 0) | (F.col("j") >= cols)
    found = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("bad")).first()
    want = size[2] if coordinate else rows * (rows + 1) // 2 if symmetric else rows * cols
    if found["bad"]:
        raise MatrixMarketError(f"{found['bad']} entries are malformed or out of range")
    if found["n"] != want:
        raise MatrixMarketError(f"{want} entries were announced, {found['n']} found")
    if symmetric:
        t = t.unionByName(t.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v", "at"))
    return t, size


def mm_read(spark: SparkSession, path: str) -> Matrix:
    """The file as a sparse matrix: duplicates add up; zeros of the array layout are dropped."""
    t, size = _triplets(spark, path)
    if len(size) == 2:
        t = t.where("v <> 0")
    return Matrix(t.groupBy("i", "j").agg(F.sum("v").alias("v")), size[0], size[1])


def mm_read_dense(spark: SparkSession, path: str) -> Matrix:
    """The file with all elements stored: of duplicates the last one in the file stands."""
    t, size = _triplets(spark, path)
    return Matrix(t.groupBy("i", "j").agg(F.max_by("v", "at").alias("v")), size[0], size[1]).dense()


def _number(v: str = "v"):
    """As C's ``%.17g`` would round: 17 significant digits."""
    return F.format_string("%.16e", F.col(v).cast("double"))


def _write(lines: DataFrame, path: str, compression: str | None = None) -> None:
    """Text file parts that, by name, are the format's one stream: lines sorted by ``at``, which is unique, over all parts. No task sees more than
    its range."""
    lines.orderBy("at").select("value").write.mode("overwrite").text(path, compression=compression)


def _with_head(a: Matrix, head: list[str], body: DataFrame) -> DataFrame:
    spark = a.df.sparkSession
    top = spark.createDataFrame([(k - len(head), h) for k, h in enumerate(head)], "at long, value string")
    return top.unionByName(body)


def mm_write(a: Matrix, path: str) -> None:
    """Array layout, column by column."""
    body = a.dense().df.select((F.col("j") * a.nrows + F.col("i")).alias("at"), _number().alias("value"))
    _write(_with_head(a, ["%%MatrixMarket matrix array real general", f"{a.nrows} {a.ncols}"], body), path)


def mm_write_sparse(a: Matrix, path: str, compression: str | None = None) -> None:
    """Coordinate layout, from 1, row by row; ``compression`` as Spark names it (gzip)."""
    body = a.df.select((F.col("i") * a.ncols + F.col("j")).alias("at"), F.concat_ws(" ", F.col("i") + 1, F.col("j") + 1, _number()).alias("value"))
    _write(_with_head(a, ["%%MatrixMarket matrix coordinate real general", f"{a.nrows} {a.ncols} {a.df.count()}"], body), path, compression)


#: Published 2-norm condition numbers of the named test matrices. Fixed values.
KAPPA = {
    "lambers_well": 1.0e1,
    "lambers_ill": 1.869050824603144e8,
    "rump6x6ill": 1.0e16,
    "faires74x3": 1.5999e4,
    "wilk21": 4.2e1,
    "Trefethen_20": 6.308860e1,
    "pores_1": 1.812616e6,
    "gre_343": 1.119763e2,
    "bcsstk01": 8.8234e5,
    "bcsstk03": 6.791333e6,
    "bcsstk04": 2.292466e6,
    "bcsstk05": 1.428114e4,
    "bcsstk22": 1.107165e5,
    "steam1": 2.827501e7,
    "steam3": 5.51e10,
    "fs_183_1": 1.5129e13,
    "fs_183_3": 1.5129e13,
    "west0132": 4.2e11,
    "west0167": 2.827e7,
    "saylr1": 7.780581e8,
}


def names(spark: SparkSession) -> DataFrame:
    """The named matrices with their condition numbers."""
    return spark.createDataFrame(list(KAPPA.items()), "name string, kappa double")


def kappa(name: str) -> float:
    if name not in KAPPA:
        raise KeyError(f"no test matrix {name!r}")
    return KAPPA[name]


def by_name(spark: SparkSession, name: str, folder: str) -> Matrix:
    """A named matrix from a folder of Matrix Market files."""
    kappa(name)
    return mm_read(spark, f"{folder}/{name}.mtx")
