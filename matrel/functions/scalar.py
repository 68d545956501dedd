"""Scalar functions of one value, with the results of IEEE arithmetic where Spark would give NULL or raise."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def _d(v: Column) -> Column:
    return v.cast("double")


def _log(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A logarithm with -inf at 0 and NaN below, where Spark has NULL."""

    def of(v: Column) -> Column:
        v = _d(v)
        return F.when(v == 0, F.lit(-INF)).when(v < 0, F.lit(NAN)).otherwise(f(v))

    return of


def signum(v: Column) -> Column:
    """-1, 0 or 1; NaN gives 0."""
    return F.when(F.isnan(_d(v)), 0).when(v > 0, 1).when(v < 0, -1).otherwise(0).cast("double")


def round_half_away(v: Column) -> Column:
    v = _d(v)
    whole = F.when(v < 0, F.ceil(v - 0.5)).otherwise(F.floor(v + 0.5)).cast("double")
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(whole)


def divide(a: Column, b: Column) -> Column:
    """Floating division: by zero it is infinite, 0 / 0 is NaN."""
    a, b = _d(a), _d(b)
    at_zero = F.when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def _erf_udf(f: Callable[[float], float]) -> Callable[[Column], Column]:
    """Spark has no error function: an Arrow batch at a time through the C library's. Typed without strings, so the decorator sees classes."""

    def over(v: pd.Series) -> pd.Series:
        return v.map(f, na_action="ignore").astype("float64")

    over.__annotations__ = {"v": pd.Series, "return": pd.Series}
    # made when used: it needs a session, which a worker that imports this module doesn't have
    return lambda v: F.when(v.isNull(), None).otherwise(F.pandas_udf(over, "double")(_d(v)))


def _is_complex(kind: str) -> bool:
    return kind.startswith("struct")


def abs_of(kind: str) -> Callable[[Column], Column]:
    return (lambda v: F.hypot(v["re"], v["im"])) if _is_complex(kind) else F.abs


def conj_of(kind: str) -> Callable[[Column], Column]:
    return (lambda v: F.struct(v["re"].alias("re"), (-v["im"]).alias("im"))) if _is_complex(kind) else (lambda v: v)


def real_of(kind: str) -> Callable[[Column], Column]:
    return (lambda v: v["re"]) if _is_complex(kind) else (lambda v: v)


def imag_of(kind: str) -> Callable[[Column], Column]:
    return (lambda v: v["im"]) if _is_complex(kind) else (lambda v: F.lit(0).cast(kind))


#: Functions of one real value, by name.
UNARY: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs,
    "acos": lambda v: F.acos(_d(v)),
    "acosh": lambda v: F.acosh(_d(v)),
    "asin": lambda v: F.asin(_d(v)),
    "asinh": lambda v: F.asinh(_d(v)),
    "atan": lambda v: F.atan(_d(v)),
    "atanh": lambda v: F.atanh(_d(v)),
    "cbrt": lambda v: F.cbrt(_d(v)),
    "ceil": lambda v: F.ceil(v).cast("double"),
    "cos": lambda v: F.cos(_d(v)),
    "cosh": lambda v: F.cosh(_d(v)),
    "erf": _erf_udf(math.erf),
    "erfc": _erf_udf(math.erfc),
    "exp": lambda v: F.exp(_d(v)),
    "exp2": lambda v: F.pow(F.lit(2.0), _d(v)),
    "floor": lambda v: F.floor(v).cast("double"),
    "log": _log(F.ln),
    "log10": _log(F.log10),
    "log2": _log(F.log2),
    "negate": lambda v: -v,
    "round": round_half_away,
    "signum": signum,
    "sin": lambda v: F.sin(_d(v)),
    "sinh": lambda v: F.sinh(_d(v)),
    "sqrt": lambda v: F.sqrt(_d(v)),
    "tan": lambda v: F.tan(_d(v)),
    "tanh": lambda v: F.tanh(_d(v)),
}

#: Functions of two values.
BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "times": lambda a, b: a * b,
    "divide": divide,
    "assign": lambda _, b: b,
    "pow": lambda a, b: F.pow(_d(a), _d(b)),
}


def scale(factor: float) -> Callable[[Column], Column]:
    """The function that multiplies by ``factor`` from the left."""
    return lambda v: F.lit(factor) * v


def rscale(factor: float) -> Callable[[Column], Column]:
    return lambda v: v * F.lit(factor)


def divide_by(factor: float) -> Callable[[Column], Column]:
    return lambda v: divide(v, F.lit(factor))


#: Monoids as (aggregate, identity by type): what an empty collection gives.
LIMITS = {"double": (1.7976931348623157e308, -1.7976931348623157e308), "float": (3.4028234663852886e38, -3.4028234663852886e38), "bigint": (2**63 - 1, -(2**63)), "int": (2**31 - 1, -(2**31)), "smallint": (2**15 - 1, -(2**15)), "tinyint": (127, -128)}


def identity_of(operation: str, kind: str) -> float:
    """The identity of ``add``, ``mult``, ``max`` or ``min`` for a type."""
    top, bottom = LIMITS[kind]
    return {"add": 0, "mult": 1, "max": bottom, "min": top}[operation]


def wrapped(v: Column, bits: int, signed: bool = True) -> Column:
    """An integer reduced modulo ``2**bits`` to the type's range; ``v`` must be wide enough to hold the true value."""
    whole = v.cast("decimal(38,0)")
    size = F.lit(str(2**bits)).cast("decimal(38,0)")
    low = F.pmod(whole, size)
    if signed:
        low = F.when(low >= F.lit(str(2 ** (bits - 1))).cast("decimal(38,0)"), low - size).otherwise(low)
    return low.cast("decimal(38,0)").cast("bigint" if bits < 64 or signed else "decimal(20,0)")


def wrap_add(a: Column, b: Column, bits: int = 64) -> Column:
    return wrapped(a.cast("decimal(38,0)") + b.cast("decimal(38,0)"), bits)


def wrap_sub(a: Column, b: Column, bits: int = 64) -> Column:
    return wrapped(a.cast("decimal(38,0)") - b.cast("decimal(38,0)"), bits)


def wrap_mul(a: Column, b: Column, bits: int = 64) -> Column:
    """The product modulo ``2**bits``; for 64 bits by halves, so that no step leaves 38 digits."""
    if bits <= 32:
        return wrapped(a.cast("decimal(38,0)") * b.cast("decimal(38,0)"), bits)
    half = F.lit(str(2**32)).cast("decimal(38,0)")
    a, b = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    low = F.pmod(b.cast("decimal(38,0)"), half).cast("decimal(10,0)")
    high = ((b - low) / half).cast("decimal(11,0)")
    top = F.pmod((a * high).cast("decimal(38,0)"), half).cast("decimal(10,0)")
    return wrapped((a * low).cast("decimal(38,0)") + (top * half).cast("decimal(38,0)"), bits)


def generic_fma(a: Column, b: Column, c: Column, bits: int = 64) -> Column:
    """``a * b + c`` modulo ``2**bits``."""
    return wrap_add(wrap_mul(a, b, bits), c, bits)
