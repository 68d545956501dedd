"""Queries over matrices derived from the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.functions import generators as gen
from matrel.functions import scalar
from matrel.functions.accumulators import WHOLE, Accumulator
from matrel.kernels import sparse
from matrel.operators import construct, elementwise, ndarray, products, properties, reductions, tensors, views
from matrel.plans import answers, files
from matrel.plans import fixtures as fx
from matrel.plans.fixtures import sql
from matrel.relation import Matrix, Vector
from matrel.sources import spy, text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLE_SQL[name] = sql(oracle)


def _q(f) -> Query:
    """A query of the square fixture."""
    return lambda s, sf: _df(f(fx.square(s, sf)))


def _qr(f) -> Query:
    return lambda s, sf: _df(f(fx.square(s, sf), fx.other(s, sf)))


def _u(f) -> Query:
    return lambda s, sf: _df(f(fx.short(s, sf)))


def _uw(f) -> Query:
    return lambda s, sf: _df(f(fx.short(s, sf), fx.short2(s, sf)))


def _a(f) -> Query:
    return lambda s, sf: _df(f(fx.quantities(s, sf)))


def _df(x) -> DataFrame:
    return x.df if isinstance(x, (Matrix, Vector)) else x


# Assembly and conversion

add("compress", lambda s, sf: construct.compress(fx.quantities_raw(s, sf)).df, "SELECT i, j, v FROM a")
add("coo_insert", _qr(lambda a, b: construct.insert(a, b.df)), "SELECT i, j, v FROM q UNION ALL SELECT i, j, v FROM r")
add("coo_sort", _q(construct.sort), "SELECT i, j, v FROM q")
_seq = "SELECT l_suppkey AS i, l_partkey AS j, CAST(l_quantity AS BIGINT) AS v, l_orderkey * 10 + l_linenumber AS seq FROM lineitem"


def _inserted(s: SparkSession, sf: str) -> DataFrame:
    return fx.table(s, sf, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("bigint").alias("v"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


add("insert_last_wins", lambda s, sf: construct.insert_last(_inserted(s, sf), 0, 0).df, f"SELECT i, j, arg_max(v, seq * 100 + v) AS v FROM ({_seq}) GROUP BY 1, 2")
add("insert_plus", lambda s, sf: construct.insert_plus(_inserted(s, sf), 0, 0).df, "SELECT i, j, v FROM a")
add("insert_with_updater", lambda s, sf: construct.insert_with(_inserted(s, sf), 0, 0, F.greatest, F.lit(0).cast("bigint")).df, "SELECT i, j, max(v) AS v FROM raw GROUP BY 1, 2")
add("shifted_insert", _q(lambda a: construct.shifted(a.df, 100, 200)), "SELECT i + 100 AS i, j + 200 AS j, v FROM q")
add("vector_insert", lambda s, sf: construct.vector_insert(_inserted(s, sf).select("i", "v", "seq"), 0).df, f"SELECT i, arg_max(v, seq * 100 + v) AS v FROM ({_seq}) GROUP BY 1")
add("vector_insert_plus", lambda s, sf: construct.vector_insert(_inserted(s, sf).select("i", "v"), 0, plus=True).df, "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM a GROUP BY 1")
add("vector_exists", _u(lambda x: construct.exists(x, x.df.sparkSession.range(60).select(F.col("id").alias("i")))), "SELECT t.i, u.i IS NOT NULL AS found FROM range(60) t(i) LEFT JOIN u ON t.i = u.i")
add("vector_crop", lambda s, sf: construct.crop(fx.sizes(s, sf), 40).df, "SELECT i, v FROM x WHERE abs(v) >= 40")
add("vector_lookup", _u(lambda x: construct.lookup_vector(x, x.df.sparkSession.range(60).select(F.col("id").alias("i")))), "SELECT t.i, coalesce(u.v, 0) AS v FROM range(60) t(i) LEFT JOIN u ON t.i = u.i")
add("matrix_lookup", lambda s, sf: construct.lookup(fx.square(s, sf), fx.other(s, sf).df.select("i", "j")), "SELECT r.i, r.j, coalesce(q.v, 0) AS v FROM r LEFT JOIN q ON r.i = q.i AND r.j = q.j")
add("ell", _q(lambda a: construct.to_ell(a).select("i", F.size("idx").cast("bigint").alias("width"), F.array_join(F.transform("idx", lambda x: x.cast("string")), ",").alias("idx"), F.array_join(F.transform("val", lambda x: x.cast("string")), ",").alias("val"))), "SELECT i, m AS width, array_to_string(list_concat(l, list_transform(range(m - len(l)), lambda k: '-1')), ',') AS idx, array_to_string(list_concat(w, list_transform(range(m - len(l)), lambda k: '0')), ',') AS val FROM (SELECT i, list(CAST(j AS VARCHAR) ORDER BY j) AS l, list(CAST(v AS VARCHAR) ORDER BY j) AS w, max(count(*)) OVER () AS m FROM q GROUP BY i)")
add("ell_round_trip", _q(lambda a: construct.from_ell(construct.to_ell(a), *a.shape)), "SELECT i, j, v FROM q")
add("csc", _q(lambda a: construct.to_csc(a).select("j", F.array_join(F.transform("idx", lambda x: x.cast("string")), ",").alias("idx"))), "SELECT j, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS idx FROM q GROUP BY j")
add("csc_to_crs", _q(lambda a: construct.from_csc(construct.to_csc(a), *a.shape)), "SELECT i, j, v FROM q")
add("csc_transpose", _q(lambda a: construct.from_csc(construct.transpose_csc(construct.to_csc(a), *a.shape), a.ncols, a.nrows)), "SELECT j AS i, i AS j, v FROM q")


def _blocks(s: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = fx.square(s, sf).df.select((F.col("i") % 3).alias("blk"), F.expr("i div 3").alias("i"), (F.col("j") % 16).alias("j"), "v").groupBy("blk", "i", "j").agg(F.sum("v").alias("v"))
    return b, s.range(3).select(F.col("id").alias("blk"), F.lit(16).alias("n"))


_blk = "SELECT i % 3 AS blk, i // 3 AS i, j % 16 AS j, CAST(sum(v) AS BIGINT) AS v FROM q GROUP BY 1, 2, 3"
add("block_diagonal", lambda s, sf: construct.block_diagonal(*_blocks(s, sf)).df, f"SELECT i + 16 * blk AS i, j + 16 * blk AS j, v FROM ({_blk}), q0".replace(", q0", ""))
ORACLE_SQL["block_diagonal"] = f"WITH q AS ({fx.SQL['q']}) SELECT CAST(i + 16 * blk AS BIGINT) AS i, CAST(j + 16 * blk AS BIGINT) AS j, v FROM ({_blk})"
add("block_diagonal_times", lambda s, sf: products.block_diagonal_times(_blocks(s, sf)[0], s.range(48).select((F.col("id") % 3).alias("blk"), F.expr("id div 3").alias("i"), (F.col("id") + 1).alias("v"))))
ORACLE_SQL["block_diagonal_times"] = f"WITH q AS ({fx.SQL['q']}), b AS ({_blk}) SELECT blk, i, CAST(sum(v * (3 * j + blk + 1)) AS BIGINT) AS v FROM b GROUP BY 1, 2"
add("identity", lambda s, sf: construct.identity(s, 25, "bigint").df, "SELECT i, i AS j, CAST(1 AS BIGINT) AS v FROM range(25) t(i)")
add("unit_vector", lambda s, sf: construct.unit_vector(s, 9, 4, "bigint").df, "SELECT i, CAST(i = 4 AS BIGINT) AS v FROM range(9) t(i)")
add("diagonal", _q(construct.diagonal), "SELECT t.i, coalesce(q.v, 0) AS v FROM range(48) t(i) LEFT JOIN q ON q.i = t.i AND q.j = t.i")
add("diag", _u(construct.diag), "SELECT i, i AS j, v FROM u")
add("convert", lambda s, sf: construct.convert(fx.sizes(s, sf), "double").df, "SELECT i, CAST(v AS DOUBLE) AS v FROM x")
add("project_saturated", _u(lambda x: construct.project_onto(x, "tinyint", 0.25).map(lambda v: v.cast("bigint"))), "SELECT i, CAST(least(127, trunc(v * 0.25)) AS BIGINT) AS v FROM u")
add("embed", lambda s, sf: construct.embed_into(fx.sizes(s, sf), "double", 0.5).df, "SELECT i, CAST(v AS DOUBLE) * 0.5 AS v FROM x")
add("fill", _u(lambda x: construct.fill(x, 7)), "SELECT i, CAST(7 AS BIGINT) AS v FROM range(48) t(i)")
add("set_to_zero", _u(construct.set_to_zero), "SELECT i, CAST(0 AS BIGINT) AS v FROM range(48) t(i)")
add("fill_random", lambda s, sf: construct.random_matrix(s, 40, 30, -1, 1, 5).df.agg(F.count("v").alias("n"), F.min(F.col("v") >= -1).alias("low"), F.max(F.col("v") < 1).alias("high")), "SELECT CAST(1200 AS BIGINT) AS n, true AS low, true AS high")
add("shape", _q(construct.shape_of), "SELECT CAST(48 AS BIGINT) AS num_rows, CAST(48 AS BIGINT) AS num_cols, CAST(2304 AS BIGINT) AS size")
add("change_dim", _q(lambda a: construct.change_dim(a, 20, 30)), "SELECT i, j, v FROM q WHERE i < 20 AND j < 30")
add("rows_form_dense", _q(lambda a: a.dense()), "SELECT t.i, s.j, coalesce(q.v, 0) AS v FROM range(48) t(i) CROSS JOIN range(48) s(j) LEFT JOIN q ON q.i = t.i AND q.j = s.j")

# Views and permutations

add("transposed", _q(views.transposed), "SELECT j AS i, i AS j, v FROM q")
for _name, _view, _where in (
    ("upper", views.upper, "i <= j"),
    ("lower", views.lower, "i >= j"),
    ("strict_upper", views.strict_upper, "i < j"),
    ("strict_lower", views.strict_lower, "i > j"),
    ("triu", lambda a: views.triu(a, 3), "j - i >= 3"),
    ("tril", lambda a: views.tril(a, -2), "j - i <= -2"),
    ("banded", lambda a: views.banded(a, 2, 5), "j - i BETWEEN -2 AND 5"),
):
    add(_name, _q(_view), f"SELECT i, j, v FROM q WHERE {_where}")
add("hermitian", _q(views.hermitian), "SELECT i, j, v FROM q WHERE i <= j UNION ALL SELECT j, i, v FROM q WHERE i < j")
add("sub_vector", lambda s, sf: views.sub_vector(fx.sizes(s, sf), 10, 200, 7).df, "SELECT (i - 10) // 7 AS i, v FROM x WHERE i >= 10 AND i < 200 AND (i - 10) % 7 = 0")
add("sub_matrix", _q(lambda a: views.sub_matrix(a, 5, 20, 8, 40)), "SELECT i - 5 AS i, j - 8 AS j, v FROM q WHERE i >= 5 AND i < 20 AND j >= 8 AND j < 40")


def _perm(s: SparkSession) -> DataFrame:
    return s.range(48).select(F.col("id").alias("new"), ((F.col("id") * 5 + 7) % 48).alias("old"))


_p = "(SELECT i AS new, (i * 5 + 7) % 48 AS old FROM range(48) t(i))"
add("mapped", lambda s, sf: views.mapped(fx.square(s, sf), _perm(s).where("new < 10"), _perm(s).where("new < 20"), 10, 20).df, f"SELECT a1.new AS i, b1.new AS j, q.v FROM q JOIN {_p} a1 ON q.i = a1.old JOIN {_p} b1 ON q.j = b1.old WHERE a1.new < 10 AND b1.new < 20")
add("row_permute", lambda s, sf: views.row_permute(fx.square(s, sf), _perm(s)).df, f"SELECT p.new AS i, q.j, q.v FROM q JOIN {_p} p ON q.i = p.old")
add("column_permute", lambda s, sf: views.column_permute(fx.square(s, sf), _perm(s)).df, f"SELECT q.i, p.new AS j, q.v FROM q JOIN {_p} p ON q.j = p.old")
add("symmetric_permute", lambda s, sf: views.symmetric_permute(fx.square(s, sf), _perm(s)).df, f"SELECT a1.new AS i, b1.new AS j, q.v FROM q JOIN {_p} a1 ON q.i = a1.old JOIN {_p} b1 ON q.j = b1.old")
add("permute_vector", lambda s, sf: views.permute_vector(fx.short(s, sf), _perm(s)).df, f"SELECT p.new AS i, u.v FROM u JOIN {_p} p ON u.i = p.old")
add("ipermute_vector", lambda s, sf: views.ipermute_vector(fx.short(s, sf), _perm(s)).df, f"SELECT p.old AS i, u.v FROM u JOIN {_p} p ON u.i = p.new")
add("permutation_times_vector", lambda s, sf: products.mult(views.permutation_matrix(_perm(s), 48, "bigint"), fx.short(s, sf)).df, f"SELECT p.new AS i, u.v FROM u JOIN {_p} p ON u.i = p.old")
add("invert_permutation", lambda s, sf: views.invert_permutation(_perm(s)), f"SELECT old AS new, new AS old FROM {_p}")
add("identity_permutation", lambda s, sf: views.identity_permutation(s, 12), "SELECT i AS new, i AS old FROM range(12) t(i)")
add("compose_permutations", lambda s, sf: views.compose_permutations(_perm(s), _perm(s)), f"SELECT b1.new, a1.old FROM {_p} b1 JOIN {_p} a1 ON b1.old = a1.new")
add("is_valid_permutation", lambda s, sf: views.is_valid_permutation(_perm(s), 48), "SELECT true AS value")
add("swap_rows", lambda s, sf: views.swap_rows(_perm(s), 3, 9), f"SELECT CASE new WHEN 3 THEN 9 WHEN 9 THEN 3 ELSE new END AS new, old FROM {_p}")
add("recursator_quadrants", _q(lambda a: views.quadrants(a)["south_east"]), "SELECT i - 32 AS i, j - 32 AS j, v FROM q WHERE i >= 32 AND j >= 32")
add("morton", _q(lambda a: a.df.select("i", "j", views.morton(F.col("i"), F.col("j"), 6).alias("z"))), "SELECT i, j, CAST(" + " + ".join(f"((j >> {b}) & 1) * {1 << (2 * b)} + ((i >> {b}) & 1) * {1 << (2 * b + 1)}" for b in range(6)) + " AS BIGINT) AS z FROM q")

# Element-wise

add("matrix_add", _qr(elementwise.add), "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, v FROM q UNION ALL SELECT i, j, v FROM r) GROUP BY 1, 2")
add("matrix_subtract", _qr(elementwise.subtract), "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, v FROM q UNION ALL SELECT i, j, -v FROM r) GROUP BY 1, 2")
add("matrix_multiply", _qr(elementwise.multiply), "SELECT q.i, q.j, q.v * r.v AS v FROM q JOIN r ON q.i = r.i AND q.j = r.j")
add("matrix_combine_max", _qr(lambda a, b: elementwise.combine(a, b, F.greatest)), "SELECT coalesce(q.i, r.i) AS i, coalesce(q.j, r.j) AS j, greatest(coalesce(q.v, 0), coalesce(r.v, 0)) AS v FROM q FULL JOIN r ON q.i = r.i AND q.j = r.j")
add("matrix_negate", _q(elementwise.negate), "SELECT i, j, -v AS v FROM q")
add("matrix_scale", _q(lambda a: elementwise.scale(a, 3)), "SELECT i, j, 3 * v AS v FROM q")
add("matrix_divide", _q(lambda a: elementwise.divide(a, 4.0)), "SELECT i, j, v / 4.0::DOUBLE AS v FROM q")
add("vector_add", _uw(elementwise.add), "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, v FROM u UNION ALL SELECT i, v FROM w) GROUP BY 1")
add("vector_subtract", _uw(elementwise.subtract), "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, v FROM u UNION ALL SELECT i, -v FROM w) GROUP BY 1")
add("vector_scale", _u(lambda x: elementwise.scale(x, 5)), "SELECT i, 5 * v AS v FROM u")
add("fused_plus_assign", _uw(lambda x, y: elementwise.fused_plus_assign(x, y, y)), "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, v FROM u UNION ALL SELECT i, 2 * v FROM w) GROUP BY 1")
add("fused_assign", _uw(lambda x, y: elementwise.fused_assign(x, y, x, y)), "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, v FROM u UNION ALL SELECT i, 2 * v FROM w) GROUP BY 1")
add("evaluate", _qr(lambda a, b: elementwise.evaluate(elementwise.add(a, b))), "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, v FROM q UNION ALL SELECT i, j, v FROM r) GROUP BY 1, 2")
add("typed_functors", _u(lambda x: x.map(lambda v: scalar.divide_by(4)(scalar.rscale(5)(scalar.scale(3)(v).cast("double"))))), "SELECT i, v * 15 / 4.0::DOUBLE AS v FROM u")
add("round_type", _u(lambda x: x.df.select("i", Accumulator(acc="float").round_out(F.col("v") / 3).cast("double").alias("low"), Accumulator(acc="bigint").round_out(F.col("v") / 3).alias("high"))), "SELECT i, CAST(CAST(v / 3.0::DOUBLE AS FLOAT) AS DOUBLE) AS low, v / 3.0::DOUBLE AS high FROM u")
add("interop_matrix", _q(lambda a: construct.as_ndarray(construct.as_matrix(construct.as_ndarray(a), 48, 48))), "SELECT t.i AS d0, s.j AS d1, CAST(coalesce(q.v, 0) AS BIGINT) AS v FROM range(48) t(i) CROSS JOIN range(48) s(j) LEFT JOIN q ON q.i = t.i AND q.j = s.j")
add("interop_vector", _u(lambda x: construct.as_vector(construct.as_ndarray(x), 48)), "SELECT t.i, CAST(coalesce(u.v, 0) AS BIGINT) AS v FROM range(48) t(i) LEFT JOIN u ON t.i = u.i")
add("power", lambda s, sf: elementwise.power(fx.sizes(s, sf), 2.0).df, "SELECT i, pow(CAST(v AS DOUBLE), 2.0) AS v FROM x")
add("transform", _u(lambda x: elementwise.transform(x, lambda v: v * 2 + 1)), "SELECT t.i, coalesce(u.v, 0) * 2 + 1 AS v FROM range(48) t(i) LEFT JOIN u ON t.i = u.i")


def _complex(s: SparkSession, sf: str) -> Vector:
    return Vector(fx.table(s, sf, "part").select(F.col("p_partkey").alias("i"), F.struct(F.col("p_size").cast("double").alias("re"), (F.col("p_partkey") % 7).cast("double").alias("im")).alias("v")), 0)


add("conj", lambda s, sf: elementwise.conj(_complex(s, sf)).df.select("i", "v.re", "v.im"), "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS re, -CAST(p_partkey % 7 AS DOUBLE) AS im FROM part")
add("real", lambda s, sf: elementwise.real(_complex(s, sf)).df, "SELECT p_partkey AS i, CAST(p_size AS DOUBLE) AS v FROM part")
add("imag", lambda s, sf: elementwise.imag(_complex(s, sf)).df, "SELECT p_partkey AS i, CAST(p_partkey % 7 AS DOUBLE) AS v FROM part")
add("dot_complex", lambda s, sf: reductions.dot(_complex(s, sf), _complex(s, sf)), "SELECT CAST(sum(CAST(p_size * p_size + (p_partkey % 7) * (p_partkey % 7) AS BIGINT)) AS DOUBLE) AS re, CAST(0 AS DOUBLE) AS im FROM part")

#: For each function a domain it is smooth on, as an expression of z = (p_size - 25) / 10, and its SQL.
_FUNCTIONS = {
    "abs": ("z", "abs(z)"),
    "acos": ("z / 4", "acos(z)"),
    "acosh": ("z + 5", "acosh(z)"),
    "asin": ("z / 4", "asin(z)"),
    "asinh": ("z", "asinh(z)"),
    "atan": ("z", "atan(z)"),
    "atanh": ("z / 4", "atanh(z)"),
    "cbrt": ("z", "cbrt(z)"),
    "ceil": ("z", "ceil(z)"),
    "cos": ("z", "cos(z)"),
    "cosh": ("z", "cosh(z)"),
    "erf": ("z", "2 / sqrt(pi()) * list_sum([pow(-1.0::DOUBLE, n) * pow(z, 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1)) for n in range(60)])"),
    "erfc": ("z", "1 - 2 / sqrt(pi()) * list_sum([pow(-1.0::DOUBLE, n) * pow(z, 2 * n + 1) / (gamma(n + 1.0::DOUBLE) * (2 * n + 1)) for n in range(60)])"),
    "exp": ("z", "exp(z)"),
    "exp2": ("z", "pow(2.0, z)"),
    "floor": ("z", "floor(z)"),
    "log": ("z + 5", "ln(z)"),
    "log10": ("z + 5", "log10(z)"),
    "log2": ("z + 5", "log2(z)"),
    "negate": ("z", "-z"),
    "round": ("z", "round(z)"),
    "signum": ("z", "sign(z)"),
    "sin": ("z", "sin(z)"),
    "sinh": ("z", "sinh(z)"),
    "sqrt": ("z + 5", "sqrt(z)"),
    "tan": ("z / 4", "tan(z)"),
    "tanh": ("z", "tanh(z)"),
}


def _function(name: str, domain: str) -> Query:
    def run(s: SparkSession, sf: str) -> DataFrame:
        z = fx.table(s, sf, "part").select(F.col("p_partkey").alias("i"), ((F.col("p_size") - 25) / 10.0).alias("z")).select("i", F.expr(domain).alias("v"))
        out = elementwise.apply(Vector(z, 0), name) if name not in ("acos", "acosh", "cos", "cosh", "erfc", "exp", "exp2", "log", "log10", "log2") else Vector(z, 0).map(scalar.UNARY[name])
        return out.df.select("i", F.round(F.col("v") * 1e6).cast("bigint").alias("micro"))

    return run


for _name, (_domain, _expr) in _FUNCTIONS.items():
    add(f"fn_{_name}", _function(_name, _domain), None if _expr is None else f"SELECT i, CAST(round(({_expr}) * 1e6) AS BIGINT) AS micro FROM (SELECT i, {_domain} AS z FROM (SELECT p_partkey AS i, CAST(p_size - 25 AS DOUBLE) / 10 AS z FROM part))")

add("divide_by_zero", _u(lambda x: Vector(x.df.select("i", scalar.divide(F.col("v") - F.col("v"), F.lit(0)).alias("v")), 48).df.agg(F.count_if(F.isnan("v")).alias("nans"))), "SELECT CAST(count(*) AS BIGINT) AS nans FROM u")
for _name, _op, _f in (("wrap_add", "+", scalar.wrap_add), ("wrap_sub", "-", scalar.wrap_sub), ("wrap_mul", "*", scalar.wrap_mul)):
    add(_name, (lambda f: lambda s, sf: fx.short(s, sf).df.select("i", f(F.col("v") * 1_000_003, F.col("v") * 999_983, 32).alias("v")))(_f), f"SELECT i, CAST(CASE WHEN m >= 2147483648 THEN m - 4294967296 ELSE m END AS BIGINT) AS v FROM (SELECT i, ((h % 4294967296) + 4294967296) % 4294967296 AS m FROM (SELECT i, CAST(v * 1000003 AS HUGEINT) {_op} CAST(v * 999983 AS HUGEINT) AS h FROM u))")

# Reductions

add("sum", lambda s, sf: reductions.total(fx.sizes(s, sf)), "SELECT CAST(sum(v) AS BIGINT) AS value FROM x")
add("product", _u(lambda x: reductions.product(x.map(lambda v: v % 2 + 1))), "SELECT product(v % 2 + 1) AS value FROM u")
add("min", lambda s, sf: reductions.minimum(fx.quantities(s, sf)), "SELECT CAST(0 AS BIGINT) AS value")
add("max", lambda s, sf: reductions.maximum(fx.quantities(s, sf)), "SELECT max(v) AS value FROM a")
add("trace", _q(reductions.trace), "SELECT CAST(coalesce(sum(v), 0) AS BIGINT) AS value FROM q WHERE i = j")
add("dot", _uw(reductions.dot), "SELECT CAST(sum(u.v * w.v) AS BIGINT) AS value FROM u JOIN w ON u.i = w.i")
add("dot_real", _uw(reductions.dot_real), "SELECT CAST(sum(u.v * w.v) AS BIGINT) AS value FROM u JOIN w ON u.i = w.i")
add("dot_wide", _uw(lambda x, y: reductions.dot(x, y, Accumulator(acc="double", result="double"))), "SELECT CAST(sum(u.v * w.v) AS DOUBLE) AS value FROM u JOIN w ON u.i = w.i")
add("dot_exact", _uw(lambda x, y: reductions.dot(x, y, Accumulator(exact=True))), "SELECT CAST(sum(u.v * w.v) AS DOUBLE) AS value FROM u JOIN w ON u.i = w.i")
add("dot_fused", _uw(lambda x, y: reductions.dot(x, y, Accumulator(fused=True))), "SELECT CAST(sum(u.v * w.v) AS DOUBLE) AS value FROM u JOIN w ON u.i = w.i")
add("dot_wrapped", _uw(lambda x, y: reductions.dot_wrapped(x, y, 16)), "SELECT CAST(CASE WHEN m >= 32768 THEN m - 65536 ELSE m END AS BIGINT) AS value FROM (SELECT sum(u.v * w.v) % 65536 AS m FROM u JOIN w ON u.i = w.i)")
add("vector_one_norm", lambda s, sf: reductions.one_norm(fx.sizes(s, sf)), "SELECT CAST(sum(abs(v)) AS BIGINT) AS value FROM x")
add("vector_two_norm", lambda s, sf: reductions.two_norm(fx.sizes(s, sf)), "SELECT sqrt(CAST(sum(v * v) AS DOUBLE)) AS value FROM x")
add("vector_infinity_norm", lambda s, sf: reductions.infinity_norm(fx.sizes(s, sf)), "SELECT max(abs(v)) AS value FROM x")
add("frobenius_norm", _a(reductions.frobenius_norm), "SELECT sqrt(CAST(sum(v * v) AS DOUBLE)) AS value FROM a")
add("matrix_one_norm", _a(reductions.one_norm), "SELECT max(s) AS value FROM (SELECT CAST(sum(abs(v)) AS BIGINT) AS s FROM a GROUP BY j)")
add("matrix_infinity_norm", _a(reductions.infinity_norm), "SELECT max(s) AS value FROM (SELECT CAST(sum(abs(v)) AS BIGINT) AS s FROM a GROUP BY i)")
add("backward_error", lambda s, sf: reductions.backward_error(fx.square(s, sf), fx.short(s, sf), fx.short2(s, sf)), "SELECT d / (na * nx + nb) AS value FROM (SELECT (SELECT CAST(max(abs(coalesce(w.v, 0) - coalesce(y.v, 0))) AS DOUBLE) FROM w FULL JOIN (SELECT q.i, sum(q.v * u.v) AS v FROM q JOIN u ON q.j = u.i GROUP BY q.i) y ON w.i = y.i) AS d, (SELECT CAST(max(s) AS DOUBLE) FROM (SELECT sum(v) AS s FROM q GROUP BY i)) AS na, (SELECT CAST(max(v) AS DOUBLE) FROM u) AS nx, (SELECT CAST(max(v) AS DOUBLE) FROM w) AS nb)")

# Products

add("spmv", lambda s, sf: products.mult(fx.quantities(s, sf), fx.sizes(s, sf)).df, "SELECT a.i, CAST(sum(a.v * x.v) AS BIGINT) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i")
add("spmv_transposed", lambda s, sf: products.mult_transposed(fx.quantities(s, sf), fx.nations(s, sf)).df, "SELECT a.j AS i, CAST(sum(a.v * n.v) AS BIGINT) AS v FROM a JOIN n ON a.i = n.i GROUP BY a.j")
add("spmv_wide", lambda s, sf: products.mult(fx.quantities(s, sf), fx.sizes(s, sf), Accumulator(acc="double", result="bigint")).df, "SELECT a.i, CAST(sum(a.v * x.v) AS BIGINT) AS v FROM a JOIN x ON a.j = x.i GROUP BY a.i")
add("axpy", _uw(lambda x, y: products.axpy(3, x, y)), "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, 3 * v AS v FROM u UNION ALL SELECT i, v FROM w) GROUP BY 1")
_mm = "SELECT q.i, r.j, CAST(sum(q.v * r.v) AS BIGINT) AS v FROM q JOIN r ON q.j = r.i GROUP BY q.i, r.j"
add("matmul", _qr(products.matmul), _mm)
add("spgemm", lambda s, sf: products.spgemm(fx.quantities(s, sf), views.transposed(fx.quantities(s, sf))).df, "SELECT b1.i, b2.i AS j, CAST(sum(b1.v * b2.v) AS BIGINT) AS v FROM a b1 JOIN a b2 ON b1.j = b2.j GROUP BY 1, 2")
add("matmul_blocks", _qr(lambda a, b: products.matmul_blocks(a, b, 16).where(F.col("v") != 0).map(lambda v: v.cast("bigint"))), _mm + " HAVING sum(q.v * r.v) <> 0")
add("matmul_quad", _qr(lambda a, b: products.matmul_quad(a.map(lambda v: v % 256), b.map(lambda v: v % 128))), "SELECT q.i, r.j, CAST(sum((q.v % 256) * (r.v % 128)) AS BIGINT) AS v FROM q JOIN r ON q.j = r.i GROUP BY q.i, r.j")
add("product_chain", lambda s, sf: fx.whole(products.chain(fx.square(s, sf), fx.other(s, sf), fx.short(s, sf), accumulator=WHOLE).df), "SELECT q.i, CAST(sum(q.v * y.v) AS BIGINT) AS v FROM q JOIN (SELECT r.i, sum(r.v * u.v) AS v FROM r JOIN u ON r.j = u.i GROUP BY r.i) y ON q.j = y.i GROUP BY q.i")
add("kron", lambda s, sf: products.kron(fx.folded(fx.square(s, sf), 6, 6), fx.folded(fx.other(s, sf), 5, 7)).df, "SELECT x1.i * 5 + y1.i AS i, x1.j * 7 + y1.j AS j, x1.v * y1.v AS v FROM (SELECT i % 6 AS i, j % 6 AS j, CAST(sum(v) AS BIGINT) AS v FROM q GROUP BY 1, 2) x1, (SELECT i % 5 AS i, j % 7 AS j, CAST(sum(v) AS BIGINT) AS v FROM r GROUP BY 1, 2) y1")
add("ger", lambda s, sf: products.ger(fx.square(s, sf), 2, fx.short(s, sf), fx.short2(s, sf)).df, "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT i, j, v FROM q UNION ALL SELECT u.i, w.i, 2 * u.v * w.v FROM u, w) GROUP BY 1, 2")
add("symv", lambda s, sf: products.symv(views.hermitian(fx.square(s, sf)), fx.short(s, sf), 2, 3, fx.short2(s, sf)).df, "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT h.i, 2 * h.v * u.v AS v FROM (SELECT i, j, v FROM q WHERE i <= j UNION ALL SELECT j, i, v FROM q WHERE i < j) h JOIN u ON h.j = u.i UNION ALL SELECT i, 3 * v FROM w) GROUP BY 1")
add("trmv", lambda s, sf: products.trmv(fx.square(s, sf), fx.short(s, sf), lower_part=True).df, "SELECT q.i, CAST(sum(q.v * u.v) AS BIGINT) AS v FROM q JOIN u ON q.j = u.i WHERE q.i >= q.j GROUP BY q.i")
add("trmv_unit", lambda s, sf: products.trmv(fx.square(s, sf), fx.short(s, sf), unit=True).df, "SELECT i, CAST(sum(v) AS BIGINT) AS v FROM (SELECT q.i, q.v * u.v AS v FROM q JOIN u ON q.j = u.i WHERE q.i < q.j UNION ALL SELECT i, v FROM u) GROUP BY 1")
add("trmm", _qr(lambda a, b: products.trmm(a, b, 2, lower_part=True)), "SELECT q.i, r.j, CAST(2 * sum(q.v * r.v) AS BIGINT) AS v FROM q JOIN r ON q.j = r.i WHERE q.i >= q.j GROUP BY q.i, r.j")
add("symm", _qr(lambda a, b: products.symm(views.hermitian(a), b)), "SELECT h.i, r.j, CAST(sum(h.v * r.v) AS BIGINT) AS v FROM (SELECT i, j, v FROM q WHERE i <= j UNION ALL SELECT j, i, v FROM q WHERE i < j) h JOIN r ON h.j = r.i GROUP BY 1, 2")
add("syrk", _q(products.syrk), "SELECT b1.i, b2.i AS j, CAST(sum(b1.v * b2.v) AS BIGINT) AS v FROM q b1 JOIN q b2 ON b1.j = b2.j GROUP BY 1, 2")
add("syr2k", _qr(products.syr2k), "SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT q.i, r.i AS j, q.v * r.v AS v FROM q JOIN r ON q.j = r.j UNION ALL SELECT r.i, q.i AS j, q.v * r.v AS v FROM q JOIN r ON q.j = r.j) GROUP BY 1, 2")
add("gram", lambda s, sf: products.syrk(fx.quantities(s, sf)).df, "SELECT b1.i, b2.i AS j, CAST(sum(b1.v * b2.v) AS BIGINT) AS v FROM a b1 JOIN a b2 ON b1.j = b2.j GROUP BY 1, 2")

# Predicates

_true, _false = "SELECT true AS value", "SELECT false AS value"
add("is_square", _q(properties.is_square), _true)
add("is_empty", _q(properties.is_empty), _false)
add("is_symmetric", _q(properties.is_symmetric), "SELECT bool_and(coalesce(q.v, 0) = coalesce(t.v, 0)) AS value FROM q FULL JOIN (SELECT j AS i, i AS j, v FROM q) t ON q.i = t.i AND q.j = t.j")
add("is_hermitian", _q(lambda a: properties.is_hermitian(views.hermitian(a))), _true)
add("is_upper_triangular", _q(lambda a: properties.is_upper_triangular(views.upper(a))), _true)
add("is_lower_triangular", _q(properties.is_lower_triangular), "SELECT bool_and(i >= j OR v = 0) AS value FROM q")
add("is_triangular", _q(lambda a: properties.is_triangular(views.lower(a))), _true)
add("is_diagonal", _q(properties.is_diagonal), "SELECT bool_and(i = j OR v = 0) AS value FROM q")
add("is_banded", _q(lambda a: properties.is_banded(a, 5, 5)), "SELECT bool_and(abs(i - j) <= 5 OR v = 0) AS value FROM q")
add("is_diagonally_dominant", _q(properties.is_diagonally_dominant), "SELECT bool_and(d >= o) AS value FROM (SELECT i, sum(CASE WHEN i = j THEN abs(v) ELSE 0 END) AS d, sum(CASE WHEN i <> j THEN abs(v) ELSE 0 END) AS o FROM q GROUP BY i)")
add("is_orthogonal", lambda s, sf: properties.is_orthogonal(views.permutation_matrix(_perm(s), 48)), _true)
add("is_normal", _q(properties.is_normal), _false)
add("product_tol", _q(properties.product_tol), "SELECT 128.0::DOUBLE * 48 * 2.220446049250313e-16 * max(abs(v)) * max(abs(v)) AS value FROM q")
add("is_zero", lambda s, sf: properties.is_zero(fx.sizes(s, sf)), "SELECT bool_and(v = 0) AS value FROM x")
add("is_finite", lambda s, sf: properties.is_finite(fx.sizes(s, sf)), _true)
add("has_nan", lambda s, sf: properties.has_nan(fx.sizes(s, sf)), _false)
add("has_inf", lambda s, sf: properties.has_inf(fx.sizes(s, sf)), _false)
add("is_normalized", lambda s, sf: properties.is_normalized(fx.sizes(s, sf)), _false)
add("is_orthogonal_to", _uw(properties.is_orthogonal_to), _false)

# N-d arrays


def _nd(s: SparkSession, sf: str) -> ndarray.NdArray:
    """4 x 6 x 5: the sizes of all parts, folded."""
    flat = fx.table(s, sf, "part").groupBy((F.col("p_partkey") % 120).alias("flat")).agg(F.sum(F.col("p_size").cast("bigint")).alias("v"))
    return ndarray._unflat(flat, (4, 6, 5), "C")


_ND = "(SELECT (p_partkey % 120) // 30 AS d0, ((p_partkey % 120) // 5) % 6 AS d1, p_partkey % 5 AS d2, CAST(sum(CAST(p_size AS BIGINT)) AS BIGINT) AS v FROM part GROUP BY 1, 2, 3)"


def _n(f) -> Query:
    return lambda s, sf: (lambda x: x.df if isinstance(x, ndarray.NdArray) else x)(f(_nd(s, sf)))


add("nd_flat", _n(ndarray.flat), f"SELECT d0 * 30 + d1 * 5 + d2 AS flat, v FROM {_ND}")
add("nd_flatten", _n(ndarray.flatten), f"SELECT d0 * 30 + d1 * 5 + d2 AS d0, v FROM {_ND}")
add("nd_reshape", _n(lambda a: ndarray.reshape(a, (8, 15))), f"SELECT (d0 * 30 + d1 * 5 + d2) // 15 AS d0, (d0 * 30 + d1 * 5 + d2) % 15 AS d1, v FROM {_ND}")
add("nd_transpose", _n(ndarray.transpose), f"SELECT d2 AS d0, d1, d0 AS d2, v FROM {_ND}")
add("nd_slice", _n(lambda a: ndarray.slice_(a, 2, slice(1, 6, 2), slice(None))), f"SELECT (d1 - 1) // 2 AS d0, d2 AS d1, v FROM {_ND} WHERE d0 = 2 AND d1 >= 1 AND (d1 - 1) % 2 = 0")
for _name, _op, _f in (("add", "+", lambda x, y: x + y), ("subtract", "-", lambda x, y: x - y), ("multiply", "*", lambda x, y: x * y)):
    add(f"nd_{_name}", _n((lambda f: lambda a: ndarray.combine(a, ndarray.reshape(ndarray.sum_axis(a, 1), (4, 1, 5)), f))(_f)), f"SELECT x1.d0, x1.d1, x1.d2, x1.v {_op} y1.v AS v FROM {_ND} x1 JOIN (SELECT d0, d2, CAST(sum(v) AS BIGINT) AS v FROM {_ND} GROUP BY 1, 2) y1 ON x1.d0 = y1.d0 AND x1.d2 = y1.d2")
add("nd_divide", _n(lambda a: ndarray.combine(a, a, scalar.divide)), f"SELECT d0, d1, d2, CAST(1 AS DOUBLE) AS v FROM {_ND}")
add("nd_fill", _n(lambda a: ndarray.fill(a, 3)), f"SELECT d0, d1, d2, CAST(3 AS BIGINT) AS v FROM {_ND}")
add("nd_scalar", _n(lambda a: a.map(lambda v: v * 2)), f"SELECT d0, d1, d2, v * 2 AS v FROM {_ND}")
add("nd_sum", _n(ndarray.sum_all), f"SELECT CAST(sum(v) AS BIGINT) AS value FROM {_ND}")
add("nd_prod", _n(lambda a: ndarray.prod_all(a.map(lambda v: v % 2 + 1))), f"SELECT product(v % 2 + 1) AS value FROM {_ND}")
add("nd_min", _n(ndarray.min_all), f"SELECT min(v) AS value FROM {_ND}")
add("nd_max", _n(ndarray.max_all), f"SELECT max(v) AS value FROM {_ND}")
add("nd_mean", _n(ndarray.mean_all), f"SELECT CAST(sum(v) // 120 AS BIGINT) AS value FROM {_ND}")
add("nd_sum_axis", _n(lambda a: ndarray.sum_axis(a, 1)), f"SELECT d0, d2 AS d1, CAST(sum(v) AS BIGINT) AS v FROM {_ND} GROUP BY 1, 2")
add("nd_mean_axis", _n(lambda a: ndarray.mean_axis(a, 0)), f"SELECT d1 AS d0, d2 AS d1, CAST(sum(v) // 4 AS BIGINT) AS v FROM {_ND} GROUP BY 1, 2")
add("nd_transform", _n(lambda a: ndarray.transform(a, lambda v: v * v)), f"SELECT d0, d1, d2, v * v AS v FROM {_ND}")
add("nd_reduce", _n(lambda a: ndarray.reduce(a, F.lit(0).cast("bigint"), lambda s, v: (s * 31 + v) % 1_000_003)), f"SELECT list_reduce(list_prepend(CAST(0 AS BIGINT), list(v ORDER BY d0, d1, d2)), lambda s, v: (s * 31 + v) % 1000003) AS value FROM {_ND}")

add("nd_broadcast_strides", lambda s, sf: s.createDataFrame([(c, k, v) for c, (a, b) in enumerate((((4, 1, 5), (4, 6, 5)), ((1, 6, 1), (4, 6, 5)))) for k, v in enumerate(ndarray.broadcast_strides(a, b))], "c long, k long, v long"), "SELECT c, k, CAST(CASE WHEN c = 0 THEN CASE k WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE 1 END ELSE CASE k WHEN 1 THEN 1 ELSE 0 END END AS BIGINT) AS v FROM range(2) a(c), range(3) b(k)")


def _layouts(s: SparkSession, sf: str) -> DataFrame:
    a = _nd(s, sf)
    kept = ndarray.NdArray(_nd(s, sf).df.persist(), a.shape, "F")
    rows = [(k, ndarray.is_c_contiguous(x), ndarray.is_f_contiguous(x), ndarray.is_view(x)) for k, x in enumerate((a, kept, ndarray.flatten(a)))]
    return s.createDataFrame(rows, "k long, c boolean, f boolean, view boolean")


add("nd_layout", _layouts, "SELECT k, k <> 1 AS c, k > 0 AS f, k <> 1 AS view FROM range(3) t(k)")

# Tensors


def _tensor(f) -> Query:
    """A 3 x 3 tensor a row, of three parts' sizes."""

    def run(s: SparkSession, sf: str) -> DataFrame:
        t = fx.table(s, sf, "part").select(F.col("p_partkey").alias("i"), F.array(*[F.array(*[((F.col("p_partkey") * (3 * a + b + 1) + F.col("p_size")) % 11).cast("double") for b in range(3)]) for a in range(3)]).alias("t"))
        return t.select("i", f(F.col("t")).alias("v"))

    return run


_c = lambda a, b: f"CAST((p_partkey * {3 * a + b + 1} + p_size) % 11 AS DOUBLE)"
add("tensor_trace", _tensor(lambda t: tensors.trace(t, 3)), f"SELECT p_partkey AS i, {_c(0, 0)} + {_c(1, 1)} + {_c(2, 2)} AS v FROM part")
add("tensor_determinant", _tensor(lambda t: tensors.determinant(t, 3)), f"SELECT p_partkey AS i, {_c(0, 0)} * ({_c(1, 1)} * {_c(2, 2)} - {_c(1, 2)} * {_c(2, 1)}) - {_c(0, 1)} * ({_c(1, 0)} * {_c(2, 2)} - {_c(1, 2)} * {_c(2, 0)}) + {_c(0, 2)} * ({_c(1, 0)} * {_c(2, 1)} - {_c(1, 1)} * {_c(2, 0)}) AS v FROM part")
add("tensor_norm", _tensor(lambda t: tensors.frobenius_norm(t)), "SELECT p_partkey AS i, sqrt(" + " + ".join(f"{_c(a, b)} * {_c(a, b)}" for a in range(3) for b in range(3)) + ") AS v FROM part")
add("tensor_add", _tensor(lambda t: tensors.at(tensors.add(t, tensors.transpose(t, 3)), 0, 1)), f"SELECT p_partkey AS i, {_c(0, 1)} + {_c(1, 0)} AS v FROM part")
add("tensor_arithmetic", _tensor(lambda t: tensors.at(tensors.negate(tensors.divide(tensors.scale(tensors.subtract(t, tensors.identity(3)), 6.0), 3.0)), 1, 1)), f"SELECT p_partkey AS i, -(({_c(1, 1)} - 1.0) * 6.0 / 3.0) AS v FROM part")
add("tensor_is_symmetric", _tensor(lambda t: tensors.is_symmetric(t, 3)), f"SELECT p_partkey AS i, {_c(0, 1)} = {_c(1, 0)} AND {_c(0, 2)} = {_c(2, 0)} AND {_c(1, 2)} = {_c(2, 1)} AS v FROM part")
add("tensor_is_antisymmetric", _tensor(lambda t: tensors.is_antisymmetric(tensors.unpack_antisymmetric(tensors.pack_antisymmetric(t, 3), 3), 3)), "SELECT p_partkey AS i, true AS v FROM part")
add("tensor_symmetric_packed", _tensor(lambda t: tensors.at(tensors.unpack_symmetric(tensors.pack_symmetric(t, 3), 3), 2, 1)), f"SELECT p_partkey AS i, ({_c(1, 2)} + {_c(2, 1)}) / 2.0::DOUBLE AS v FROM part")
add("tensor_symmetric_trace", _tensor(lambda t: tensors.trace_symmetric(tensors.pack_symmetric(t, 3), 3)), f"SELECT p_partkey AS i, {_c(0, 0)} + {_c(1, 1)} + {_c(2, 2)} AS v FROM part")
add("tensor_antisymmetric_set", _tensor(lambda t: tensors.at(tensors.unpack_antisymmetric(tensors.set_antisymmetric(tensors.pack_antisymmetric(t, 3), 3, 2, 0, 5.0), 3), 0, 2)), "SELECT p_partkey AS i, CAST(-5 AS DOUBLE) AS v FROM part")
add("tensor_contract", _qr(lambda a, b: tensors.contract(tensors.bind(a.df, "i", "k"), tensors.bind(b.df, "k", "j"))), _mm)
add("tensor_contract_vector", lambda s, sf: tensors.contract(tensors.bind(fx.square(s, sf).df, "i", "k"), tensors.bind(fx.short(s, sf).df, "k")), "SELECT q.i, CAST(sum(q.v * u.v) AS BIGINT) AS v FROM q JOIN u ON q.j = u.i GROUP BY q.i")
add("tensor_outer", lambda s, sf: tensors.outer(tensors.bind(fx.short(s, sf).df, "i"), tensors.bind(fx.short2(s, sf).df, "j")), "SELECT u.i, w.i AS j, u.v * w.v AS v FROM u, w")
add("tensor_lower", lambda s, sf: tensors.lower(tensors.relation(s, [[-1, 0], [0, 1]], "i", "j"), fx.short(s, sf).df.where("i < 2").select("i", F.col("v").cast("double").alias("v"))), "SELECT i, CASE i WHEN 0 THEN -CAST(v AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS v FROM u WHERE i < 2")

_flipped = lambda s: tensors.relation(s, [[(-1 if i == 0 else 1) * (i == j) for j in range(48)] for i in range(48)], "i", "j")
for _name, _f, _axis in (("lower_first", tensors.lower_first, "i"), ("lower_second", tensors.lower_second, "j"), ("raise_first", tensors.raise_first, "i"), ("raise_second", tensors.raise_second, "j")):
    add(f"tensor_{_name}", (lambda f: lambda s, sf: f(_flipped(s), fx.square(s, sf).df.select("i", "j", F.col("v").cast("double").alias("v"))).where("v <> 0"))(_f), f"SELECT i, j, CASE WHEN {_axis} = 0 THEN -CAST(v AS DOUBLE) ELSE CAST(v AS DOUBLE) END AS v FROM q WHERE v <> 0")
add("tensor_metrics", lambda s, sf: s.range(16).select(F.expr("id div 4").alias("i"), (F.col("id") % 4).alias("j"), *[F.get(F.get(m, F.expr("int(id div 4)")), F.expr("int(id % 4)")).alias(n) for n, m in (("euclidean", tensors.euclidean_metric(4)), ("minkowski", tensors.minkowski_metric()))]), "SELECT i, j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS euclidean, CAST(CASE WHEN i <> j THEN 0 WHEN i = 0 THEN -1 ELSE 1 END AS DOUBLE) AS minkowski FROM range(4) a(i), range(4) b(j)")

# Recursion and accumulation


def _recursed(s: SparkSession, sf: str) -> DataFrame:
    """The sum of each base block."""
    parts = views.for_each(fx.square(s, sf), 16, lambda x, r, c: x.df.agg(F.sum("v").alias("v")).select(F.lit(r).cast("bigint").alias("r"), F.lit(c).cast("bigint").alias("c"), "v"))
    return functools.reduce(DataFrame.unionByName, parts)


add("for_each_block", _recursed, "SELECT i // 16 * 16 AS r, j // 16 * 16 AS c, CAST(sum(v) AS BIGINT) AS v FROM q GROUP BY 1, 2")
add("base_case", lambda s, sf: s.createDataFrame([(m, n, views.is_base_case(Matrix(s.range(0), m, n), 4), views.is_base_case(Matrix(s.range(0), m, n), 4, True)) for m in range(1, 9) for n in range(1, 9)], "m long, n long, largest boolean, smallest boolean"), "SELECT m, n, greatest(m, n) <= 4 AS largest, least(m, n) <= 4 AS smallest FROM range(1, 9) a(m), range(1, 9) b(n)")


def _accumulated(s: SparkSession, sf: str) -> DataFrame:
    """Quantities by order group and part, added up in a sparse accumulator for each group, some of them in several batches."""
    rows = fx.table(s, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("id"), (F.col("l_partkey") % 100).alias("j"), F.col("l_quantity").cast("double").alias("v"))

    def run(keys: tuple, f: pd.DataFrame) -> pd.DataFrame:
        own = sparse.SparseAccumulator(100)
        own.scatter(np.arange(100), 7.0)
        own.clear()
        for k in range(0, len(f), 500):
            own.scatter(f["j"].to_numpy()[k : k + 500], f["v"].to_numpy()[k : k + 500])
        at = own.indices()
        return pd.DataFrame({"id": keys[0], "j": at, "v": [int(own[k]) for k in at], "nnz": own.nnz()})

    return rows.groupBy("id").applyInPandas(run, "id long, j long, v long, nnz long")


add("sparse_accumulator", _accumulated, "SELECT id, j, v, CAST(count(*) OVER (PARTITION BY id) AS BIGINT) AS nnz FROM (SELECT l_orderkey % 50 AS id, l_partkey % 100 AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)")

# Generators

add("arange", lambda s, sf: gen.arange(s, 3, 50, 4).df, "SELECT i, 3 + 4 * i AS v FROM range(12) t(i)")
add("linspace", lambda s, sf: gen.linspace(s, 0, 8, 17).df, "SELECT i, i * 0.5::DOUBLE AS v FROM range(17) t(i)")
add("logspace", lambda s, sf: gen.logspace(s, 0, 4, 5, 2.0).df, "SELECT i, pow(2.0::DOUBLE, i) AS v FROM range(5) t(i)")
add("geomspace", lambda s, sf: gen.geomspace(s, 1, 16, 5).df.select("i", F.round("v", 6).alias("v")), "SELECT i, pow(2.0::DOUBLE, i) AS v FROM range(5) t(i)")
_g = lambda n, value, where="true": f"SELECT i, j, CAST({value} AS DOUBLE) AS v FROM range({n}) t(i), range({n}) s(j) WHERE {where}"
add("hilbert", lambda s, sf: gen.hilbert(s, 9).df, _g(9, "1.0::DOUBLE / (i + j + 1)"))
add("lotkin", lambda s, sf: gen.lotkin(s, 9).df, _g(9, "CASE WHEN i = 0 THEN 1 ELSE 1.0::DOUBLE / (i + j + 1) END"))
add("lehmer", lambda s, sf: gen.lehmer(s, 9).df, _g(9, "CAST(least(i, j) + 1 AS DOUBLE) / (greatest(i, j) + 1)"))
add("minij", lambda s, sf: gen.minij(s, 9).df, _g(9, "least(i, j) + 1"))
add("frank", lambda s, sf: gen.frank(s, 9).df, _g(9, "9 - greatest(i, j)", "j + 1 >= i"))
add("moler", lambda s, sf: gen.moler(s, 9).df, _g(9, "CASE WHEN i = j THEN i + 1 ELSE least(i, j) - 1 END"))
add("ones", lambda s, sf: gen.ones(s, 5, 5).df, _g(5, "1"))
add("pascal", lambda s, sf: gen.pascal(s, 7).df, _g(7, "factorial(CAST(i + j AS INTEGER)) / factorial(CAST(i AS INTEGER)) / factorial(CAST(j AS INTEGER))"))
add("vandermonde", lambda s, sf: gen.vandermonde(s, [1, 2, 3, 4]).df, _g(4, "pow(i + 1, j)"))
add("wilkinson", lambda s, sf: gen.wilkinson(s, 9).df, _g(9, "CASE WHEN i = j THEN abs(i - 4) ELSE 1 END", "abs(i - j) <= 1"))
add("clement", lambda s, sf: gen.clement(s, 9).df, _g(9, "sqrt(CAST(greatest(i, j) * (9 - greatest(i, j)) AS DOUBLE))", "abs(i - j) = 1"))
add("companion", lambda s, sf: gen.companion(s, [1.0, -2.0, 3.0]).df, "SELECT * FROM (VALUES (CAST(0 AS BIGINT), CAST(2 AS BIGINT), -1.0::DOUBLE), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 1.0), (2, 2, -3.0)) t(i, j, v)")
add("forsythe", lambda s, sf: gen.forsythe(s, 6, 0.5, 2.0).df, _g(6, "CASE WHEN i = j THEN 2 WHEN j = i + 1 THEN 1 ELSE 0.5 END", "i = j OR j = i + 1 OR (i = 5 AND j = 0)"))
add("kahan", lambda s, sf: gen.kahan(s, 6).df.select("i", "j", F.round(F.col("v") * 1e9).cast("bigint").alias("nano")), "SELECT i, j, CAST(round(CASE WHEN i = j THEN 25 ELSE -cos(1.2::DOUBLE) END * pow(sin(1.2::DOUBLE), i) * 1e9) AS BIGINT) AS nano FROM range(6) t(i), range(6) s(j) WHERE i <= j")
add("rosser", lambda s, sf: s.createDataFrame([(k, int(round(w * 1e6))) for k, w in enumerate(np.linalg.eigvalsh(gen.rosser(s).to_numpy()))], "k long, v long"), "SELECT k, CAST(round(1000000 * w) AS BIGINT) AS v FROM (VALUES (0, -10 * sqrt(10405.0::DOUBLE)), (1, 0.0::DOUBLE), (2, 510 - 100 * sqrt(26.0::DOUBLE)), (3, 1000.0::DOUBLE), (4, 1000.0::DOUBLE), (5, 510 + 100 * sqrt(26.0::DOUBLE)), (6, 1020.0::DOUBLE), (7, 10 * sqrt(10405.0::DOUBLE))) t(k, w)")
add("magic_sums", lambda s, sf: gen.magic(s, 9).df.groupBy("i").agg(F.sum("v").alias("v")), "SELECT i, CAST(369 AS DOUBLE) AS v FROM range(9) t(i)")
add("magic_even", lambda s, sf: gen.magic(s, 8).df, _g(8, "CASE WHEN i % 4 = j % 4 OR i % 4 + j % 4 = 3 THEN 64 - i * 8 - j ELSE i * 8 + j + 1 END"))
add("laplacian_1d", lambda s, sf: gen.laplacian_1d(s, 20).df, _g(20, "CASE WHEN i = j THEN 2 ELSE -1 END", "abs(i - j) <= 1"))
_lap = "abs(i // 12 - j // 12) + abs(i % 12 - j % 12)"
add("laplacian_2d", lambda s, sf: gen.laplacian_2d(s, 12, 12).df, _g(144, "CASE WHEN i = j THEN 4 ELSE -1 END", f"{_lap} <= 1"))
add("poisson2d", lambda s, sf: gen.poisson2d_dirichlet(s, 12, 12).df, _g(144, "169 * CASE WHEN i = j THEN 4 ELSE -1 END", f"{_lap} <= 1"))

# Grids and printed forms

add("spy_nonzeros", _q(spy.for_each_nonzero), "SELECT i, j, v FROM q WHERE v <> 0")
add("print_sparse", _q(text.print_sparse), "SELECT i, j, '(' || i || ', ' || j || ') = ' || v AS line FROM q")
add("print_matlab", _q(lambda a: text.print_matlab(a)), "SELECT 'A = [' || string_agg(l, '; ' ORDER BY i) || ']' AS text FROM (SELECT t.i, string_agg(CAST(coalesce(q.v, 0) AS VARCHAR), ', ' ORDER BY s.j) AS l FROM range(48) t(i) CROSS JOIN range(48) s(j) LEFT JOIN q ON q.i = t.i AND q.j = s.j GROUP BY t.i)")

# Solvers by joins


def _jacobi(s: SparkSession, sf: str) -> DataFrame:
    """One distributed sweep from x: ``x + D^-1 (b - A x)``, all by joins."""
    a, x, b = construct.convert(products.syrk(fx.square(s, sf)), "double"), construct.convert(fx.short(s, sf), "double"), construct.convert(fx.short2(s, sf), "double")
    r = products.residual(a, x, b)
    step = r.df.join(a.df.where("i = j").select("i", F.col("v").alias("d")), "i").select("i", (F.col("v") / F.col("d")).alias("v"))
    return elementwise.add(x, Vector(step, 48)).df.select("i", F.round(F.col("v") * 1e4).cast("bigint").alias("v"))


add("jacobi_sweep", _jacobi, "SELECT i, CAST(round(CAST(sum(v) AS DOUBLE) * 1e4) AS BIGINT) AS v FROM (SELECT i, CAST(v AS DOUBLE) AS v FROM u UNION ALL SELECT y.i, CAST(y.v AS DOUBLE) / d.d FROM (SELECT i, sum(v) AS v FROM (SELECT i, v FROM w UNION ALL SELECT g.i, -g.v * u.v FROM (SELECT b1.i, b2.i AS j, sum(b1.v * b2.v) AS v FROM q b1 JOIN q b2 ON b1.j = b2.j GROUP BY 1, 2) g JOIN u ON g.j = u.i) GROUP BY i) y JOIN (SELECT i, sum(v * v) AS d FROM q GROUP BY i) d ON y.i = d.i) GROUP BY i")

for _module in (answers, files):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
