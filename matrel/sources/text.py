"""Delimited and triplet text files, and printed forms."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.relation import Matrix, Vector


def read_dense(spark: SparkSession, path: str, delimiter: str = ",") -> Matrix:
    """Rows of numbers. Blank lines are skipped; the first row sets the width, short rows are filled with zeros and long ones cut; an empty file raises.

    Rows are numbered by a running count over the splits' row counts, so the file is never gathered.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    counts = {r["part"]: (r["n"], r["low"]) for r in lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")).collect()}
    if not counts:
        raise ValueError("the file is empty")
    base, total = [], 0
    for part in sorted(counts):
        n, low = counts[part]
        base.append(F.struct(F.lit(part).alias("part"), F.lit(low).alias("low"), F.lit(total).alias("base")))
        total += n
    # numbers rise by one within a split, except for skipped blank lines: rank them there
    from pyspark.sql.window import Window

    ranked = lines.withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("at")) - 1)
    start = F.element_at(F.map_from_entries(F.transform(F.array(*base), lambda x: F.struct(x["part"], x["base"]))), F.col("part"))
    first = lines.orderBy("at").limit(1).collect()[0]["value"]
    width = len([x for x in first.split(delimiter)])
    cells = ranked.select((F.col("nth") + start).cast("long").alias("i"), F.posexplode(F.split("value", re.escape(delimiter))).alias("j", "w"))
    stored = cells.where(F.col("j") < width).select("i", F.col("j").cast("long").alias("j"), F.coalesce(F.trim("w").try_cast("double"), F.lit(0.0)).alias("v"))
    return Matrix(stored, total, width).dense()


def read_sparse(spark: SparkSession, path: str, nrows: int, ncols: int) -> Matrix:
    """Lines ``row column value`` from 0; duplicates add up; an index out of range raises."""
    words = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).where(F.trim("value") != "").select(words[0].cast("long").alias("i"), words[1].cast("long").alias("j"), words[2].cast("double").alias("v"))
    out = t.select(F.when(F.col("i").between(0, nrows - 1), F.col("i")).otherwise(F.raise_error(F.lit("row out of range")).cast("long")).alias("i"), F.when(F.col("j").between(0, ncols - 1), F.col("j")).otherwise(F.raise_error(F.lit("column out of range")).cast("long")).alias("j"), "v")
    return Matrix(out.groupBy("i", "j").agg(F.sum("v").alias("v")), nrows, ncols)


def general(v: Column, digits: int = 6) -> Column:
    """A number as C's ``%g`` and its streams print it: so many significant digits, no zeros at the end, an exponent below 1e-4 and from 1e``digits``."""
    v = v.cast("double")
    parts = F.split(F.format_string(f"%.{digits - 1}e", v), "e")
    power = F.get(parts, 1).cast("int")
    short = lambda x: F.regexp_replace(x, r"(\.\d*?)0+$", "$1")
    bare = lambda x: F.regexp_replace(short(x), r"\.$", "")
    plain = bare(F.concat_ws("e", F.get(parts, 0), F.get(parts, 1)).cast(f"decimal(38,{digits + 4})").cast("string"))
    sign = F.when(v < 0, "-").otherwise("")
    odd = F.when(F.isnan(v), "nan").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf"))).when(v == 0, "0")
    return odd.when((power < -4) | (power >= digits), F.concat(bare(F.get(parts, 0)), F.lit("e"), F.get(parts, 1))).otherwise(plain)


def dense_lines(a: Matrix, delimiter: str = ",", number: Callable[[Column], Column] | None = None) -> DataFrame:
    """Rows ``i, line``."""
    rows = a.dense().df.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("r"))
    return rows.select("i", F.array_join(F.transform("r", lambda x: number(x["v"]) if number else x["v"].cast("string")), delimiter).alias("line"))


def write_dense(a: Matrix, path: str, delimiter: str = ",") -> None:
    """Delimited rows, sorted over the text file parts; no task sees more than its range."""
    dense_lines(a, delimiter).orderBy("i").select("line").write.mode("overwrite").text(path)


def write_sparse(a: Matrix, path: str) -> None:
    """Lines ``row column value`` from 0."""
    a.df.orderBy("i", "j").select(F.concat_ws(" ", "i", "j", F.col("v").cast("string")).alias("value")).write.mode("overwrite").text(path)


def print_lines(a: Matrix | Vector) -> DataFrame:
    """Rows as text with six significant digits, as a stream would print them."""
    if isinstance(a, Vector):
        return a.dense().df.select("i", general(F.col("v")).alias("line"))
    return dense_lines(Matrix(a.df.select("i", "j", F.col("v").cast("double").alias("v")), *a.shape), " ", general)


def print_sparse(a: Matrix) -> DataFrame:
    """A line ``(row, column) = value`` for each stored entry."""
    return a.df.select("i", "j", F.format_string("(%d, %d) = %s", F.col("i"), F.col("j"), F.col("v").cast("string")).alias("line"))


def print_matlab(a: Matrix, name: str = "A") -> DataFrame:
    """One row with ``name = [.. ; ..]``."""
    rows = dense_lines(a, ", ").agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("r"))
    return rows.select(F.concat(F.lit(f"{name} = ["), F.array_join(F.col("r.line"), "; "), F.lit("]")).alias("text"))
