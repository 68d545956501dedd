"""Wide elements: decimals of as many digits as the decimal context has, and complex numbers of them, in NumPy arrays of objects.

The kernels of ``kernels/dense.py`` that say so take them: their results then hold more than the 53 bits of a double.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from contextlib import contextmanager
from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Digits of wide elements: the 38 of Spark's largest decimal, and as many again for what rounding takes.
DIGITS = 76


@contextmanager
def digits(n: int = DIGITS) -> Iterator[None]:
    with decimal.localcontext() as context:
        context.prec = n
        yield


def wide(a: np.ndarray) -> np.ndarray:
    """The same numbers as decimals, exactly."""
    return np.frompyfunc(Decimal, 1, 1)(np.asarray(a).astype(object))


def is_wide(a: np.ndarray) -> bool:
    return np.asarray(a).dtype == object


def tiny() -> Decimal:
    """What counts as rounding beside 1."""
    return Decimal(10) ** (4 - decimal.getcontext().prec)


def whole(x) -> Decimal:
    """The nearest whole number, halves away from zero as in SQL; what rounding left 20 places behind the point doesn't count."""
    return round(Decimal(x.real), 20).to_integral_value(ROUND_HALF_UP)


class WideComplex:
    """A complex number of two decimals."""

    __slots__ = ("imag", "real")

    def __init__(self, real, imag=0):
        self.real, self.imag = real, imag

    @staticmethod
    def of(x) -> WideComplex:
        return x if isinstance(x, WideComplex) else WideComplex(Decimal(x), Decimal(0))

    def __add__(self, x):
        if isinstance(x, np.ndarray):
            return NotImplemented
        x = WideComplex.of(x)
        return WideComplex(self.real + x.real, self.imag + x.imag)

    __radd__ = __add__

    def __neg__(self):
        return WideComplex(-self.real, -self.imag)

    def __sub__(self, x):
        return self + -WideComplex.of(x)

    def __rsub__(self, x):
        return WideComplex.of(x) - self

    def __mul__(self, x):
        if isinstance(x, np.ndarray):
            return NotImplemented
        if isinstance(x, (Decimal, int)):
            return WideComplex(self.real * x, self.imag * x)
        return WideComplex(self.real * x.real - self.imag * x.imag, self.real * x.imag + self.imag * x.real)

    __rmul__ = __mul__

    def __truediv__(self, x):
        if isinstance(x, (Decimal, int)):
            return WideComplex(self.real / x, self.imag / x)
        size = x.real * x.real + x.imag * x.imag
        return self * x.conjugate() / size

    def __pow__(self, n: int):
        out = self
        for _ in range(n - 1):
            out = out * self
        return out

    def __abs__(self) -> Decimal:
        return (self.real * self.real + self.imag * self.imag).sqrt()

    def __complex__(self) -> complex:
        return complex(float(self.real), float(self.imag))

    def conjugate(self) -> WideComplex:
        return WideComplex(self.real, -self.imag)

    def sqrt(self) -> WideComplex:
        part = ((abs(self) + abs(self.real)) / 2).sqrt()
        if part == 0:
            return self
        other = abs(self.imag) / (2 * part)
        re, im = (part, other) if self.real >= 0 else (other, part)
        return WideComplex(re, -im if self.imag < 0 else im)
