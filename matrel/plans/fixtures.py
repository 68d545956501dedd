"""Matrices and vectors of the driver's tables, with the SQL that makes the same relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.relation import Matrix, Vector


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _size(spark: SparkSession, sf: str, name: str, key: str) -> int:
    return int(table(spark, sf, name).agg(F.coalesce(F.max(key), F.lit(0))).first()[0]) + 1


def quantities_raw(spark: SparkSession, sf: str) -> Matrix:
    """Supplier by part, quantities as they come: duplicates."""
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    return Matrix(rows, _size(spark, sf, "supplier", "s_suppkey"), _size(spark, sf, "part", "p_partkey"))


def quantities(spark: SparkSession, sf: str) -> Matrix:
    a = quantities_raw(spark, sf)
    return Matrix(a.df.groupBy("i", "j").agg(F.sum("v").alias("v")), *a.shape)


def square(spark: SparkSession, sf: str) -> Matrix:
    """48 x 48: all quantities, folded."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 48).alias("i"), (F.col("l_partkey") % 48).alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    return Matrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), 48, 48)


def other(spark: SparkSession, sf: str) -> Matrix:
    """Another 48 x 48."""
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 48).alias("i"), (F.col("l_suppkey") % 48).alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    return Matrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), 48, 48)


def folded(a: Matrix, nrows: int, ncols: int) -> Matrix:
    """All entries summed into a smaller matrix."""
    rows = a.df.select((F.col("i") % nrows).alias("i"), (F.col("j") % ncols).alias("j"), "v")
    return Matrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), nrows, ncols)


def sizes(spark: SparkSession, sf: str) -> Vector:
    """By part."""
    return Vector(table(spark, sf, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("bigint").alias("v")), _size(spark, sf, "part", "p_partkey"))


def nations(spark: SparkSession, sf: str) -> Vector:
    """By supplier."""
    return Vector(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_nationkey") + 1).cast("bigint").alias("v")), _size(spark, sf, "supplier", "s_suppkey"))


def short(spark: SparkSession, sf: str) -> Vector:
    """48 numbers."""
    rows = table(spark, sf, "part").groupBy((F.col("p_partkey") % 48).alias("i")).agg(F.sum(F.col("p_size").cast("bigint")).alias("v"))
    return Vector(rows, 48)


def short2(spark: SparkSession, sf: str) -> Vector:
    rows = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 48).alias("i")).agg(F.count("o_orderkey").alias("v"))
    return Vector(rows, 48)


def whole(df: DataFrame) -> DataFrame:
    """A few rows whose ``v`` are whole numbers: bigint, as in SQL, if all fit, else decimal(38,0), where SQL's cast to BIGINT fails."""
    rows = [r.asDict() for r in df.collect()]
    fits = all(r["v"] is None or -(2**63) <= r["v"] < 2**63 for r in rows)
    kind = "bigint" if fits else "decimal(38,0)"
    out = [tuple(int(x) if k == "v" and fits and x is not None else x for k, x in r.items()) for r in rows]
    return df.sparkSession.createDataFrame(out, ", ".join(f"{k} {kind if k == 'v' else t}" for k, t in df.dtypes))


#: The same relations in SQL.
SQL = {
    "raw": "SELECT l_suppkey AS i, l_partkey AS j, CAST(l_quantity AS BIGINT) AS v FROM lineitem",
    "a": "SELECT l_suppkey AS i, l_partkey AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "q": "SELECT l_orderkey % 48 AS i, l_partkey % 48 AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "r": "SELECT l_orderkey % 48 AS i, l_suppkey % 48 AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2",
    "x": "SELECT p_partkey AS i, CAST(p_size AS BIGINT) AS v FROM part",
    "n": "SELECT s_suppkey AS i, CAST(s_nationkey + 1 AS BIGINT) AS v FROM supplier",
    "u": "SELECT p_partkey % 48 AS i, CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS v FROM part GROUP BY 1",
    "w": "SELECT o_custkey % 48 AS i, CAST(count(*) AS BIGINT) AS v FROM orders GROUP BY 1",
}


def sql(body: str) -> str:
    """A query over those relations, of which it names some."""
    import re

    used = [k for k in SQL if re.search(rf"(?i)\b(from|join|,)\s*{k}\b", body)]
    return "WITH " + ", ".join(f"{k} AS ({SQL[k]})" for k in used) + " " + body if used else body
