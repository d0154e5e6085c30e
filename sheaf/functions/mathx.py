"""Arithmetic with IEEE edges, and integer bit functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAN, _INF = float("nan"), float("inf")


def log(x: Column, base: str = "e") -> Column:
    """ln, log2 or log10: -inf at 0, NaN below."""
    own = {"e": F.log, "2": F.log2, "10": F.log10}[base]
    return F.when(x == 0, F.lit(-_INF)).when(x < 0, F.lit(_NAN)).otherwise(own(x))


def divide(a: Column, b: Column) -> Column:
    """Float division with signed infinities and NaN."""
    a, b = a.cast("double"), b.cast("double")
    over = F.when(F.isnan(a) | (a == 0), F.lit(_NAN)).when(a > 0, F.lit(_INF)).otherwise(F.lit(-_INF))
    return F.when(b == 0, over).otherwise(F.try_divide(a, b))


def modulo_float(a: Column, b: Column) -> Column:
    """The remainder with the sign of a; NaN for b = 0."""
    return F.when(b == 0, F.lit(_NAN)).otherwise(a % F.when(b == 0, F.lit(1.0)).otherwise(b))


def modulo_int(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0)).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b)).cast("bigint")


def add_int(a: Column, b: Column) -> Column:
    """Integer sum; 0 beyond 64 bits."""
    return F.coalesce(F.try_add(a, b), F.lit(0).cast("bigint"))


def subtract_int(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_subtract(a, b), F.lit(0).cast("bigint"))


def multiply_int(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.lit(0).cast("bigint"))


def bit_and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bit_or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bit_xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bit_not(a: Column) -> Column:
    return F.bitwise_not(a)


def shift_left(a: Column, n: int) -> Column:
    return F.shiftleft(a, n % 64)


def shift_right(a: Column, n: int) -> Column:
    """Arithmetic: the sign stays."""
    return F.shiftright(a, n % 64)


def shift_right_logical(a: Column, n: int) -> Column:
    return F.shiftrightunsigned(a, n % 64)
