"""Precisions of sums of products: of the elements, of the accumulator and of the result."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Accumulator:
    """``acc``: the type products and sums are formed in (None: Spark's own); ``result``: the type returned (None: as it is).

    ``exact`` sums the exact products and rounds once; ``fused`` rounds once a step (product and addition together). These two
    fold in NumPy, an Arrow batch a group; the rest stays a plain sum that Spark splits into partial sums.
    """

    acc: str | None = None
    result: str | None = None
    fused: bool = False
    exact: bool = False

    def sum_of_products(self, a: Column, b: Column) -> Column:
        if self.fused or self.exact:
            out = _fold(self.exact)(a.cast("double"), b.cast("double"))
        elif self.acc:
            out = F.sum((a.cast(self.acc) * b.cast(self.acc)).cast(self.acc))
        else:
            out = F.sum(a * b)
        return out.cast(self.result) if self.result else out

    def round_out(self, v: Column) -> Column:
        """To the type in which a root is taken: the accumulator's if it is floating, else double."""
        return v.cast(self.acc if self.acc in ("float", "double") else "double")


def fused_sum(a: np.ndarray, b: np.ndarray) -> float:
    """Multiply-add with one rounding a step, in order."""
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if np.isfinite(x) and np.isfinite(y) and np.isfinite(total):
            total = float(Fraction(x) * Fraction(y) + Fraction(total))
        else:
            total = total + x * y
    return total


def exact_sum(a: np.ndarray, b: np.ndarray) -> float:
    """All exact products summed exactly, rounded once."""
    if not (np.isfinite(a).all() and np.isfinite(b).all()):
        return float((a * b).sum())
    return float(sum((Fraction(x) * Fraction(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)), Fraction(0)))


def _fold(exact: bool):
    kernel = exact_sum if exact else fused_sum

    def fold(a: pd.Series, b: pd.Series) -> float:
        return kernel(a.to_numpy(), b.to_numpy())

    fold.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": float}
    return F.pandas_udf(fold, "double")


PLAIN = Accumulator()
#: Whole numbers of up to 38 digits: the sums of products of long elements that long can't hold.
WHOLE = Accumulator("decimal(38,0)")
