"""Text, integer and float conversions that never fail, and truth and comparison by kind.

A kind is "int", "float" or "str": what the caller knows a column to be.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
INTEGER = r"^[+-]?[0-9]+"
MAX_LONG, MIN_LONG = (1 << 63) - 1, -(1 << 63)


def to_num(text: Column) -> Column:
    """The number that a text begins with, else 0.0."""
    return F.coalesce(F.regexp_extract(text, NUMBER, 0).try_cast("double"), F.lit(0.0))


def to_int(text: Column) -> Column:
    """The integer that a text begins with; 0 without one or beyond 64 bits."""
    return F.coalesce(F.regexp_extract(text, INTEGER, 0).try_cast("bigint"), F.lit(0).cast("bigint"))


def float_to_int(x: Column) -> Column:
    """Truncated towards zero, saturated, NaN as 0."""
    inside = F.when(F.isnan(x) | x.isNull(), F.lit(0)).otherwise(F.greatest(F.lit(-9.2e18), F.least(F.lit(9.2e18), x))).cast("bigint")
    return F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x >= 9.223372036854775807e18, F.lit(MAX_LONG)).when(x <= -9.223372036854775808e18, F.lit(MIN_LONG)).otherwise(inside)


def num_to_text(x: Column) -> Column:
    """The shortest text that reads back as x: no trailing .0, plain digits from 1e-5 below 1e16, else like 1.5e20."""
    text = x.cast("string")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    sign = F.when(x < 0, "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)", 1), r"(\.0$)|\.", "")
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), F.greatest(F.lit(0), -exponent - 1)), digits)
    large = F.concat(sign, F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, F.length(digits)))
    scientific = F.concat(F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)E", 1), r"\.0$", ""), F.lit("e"), exponent.cast("string"))
    whole = F.greatest(F.lit(-1e16), F.least(F.lit(1e16), F.when(F.isnan(x), F.lit(0.0)).otherwise(x))).cast("bigint").cast("string")
    return (
        F.when(F.isnan(x), "NaN")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .when((F.abs(x) < 1e16) & (x == F.rint(x)), whole)
        .when(exponent.isNull(), F.regexp_replace(text, r"\.0$", ""))
        .when((exponent < 0) & (exponent >= -5), small)
        .when((exponent > 0) & (exponent < 16), large)
        .otherwise(scientific)
    )


def truthy(x: Column, kind: str) -> Column:
    """Integers other than 0, floats whose integer part is not 0, texts that are not empty."""
    if kind == "str":
        return F.coalesce(x != "", F.lit(False))
    return F.coalesce((float_to_int(x) if kind == "float" else x) != 0, F.lit(False))


def as_kind(x: Column, have: str, want: str) -> Column:
    """x, of one kind, converted to another."""
    if have == want:
        return x
    if want == "str":
        return num_to_text(x) if have == "float" else x.cast("string")
    if want == "float":
        return to_num(x) if have == "str" else x.cast("double")
    return to_int(x) if have == "str" else float_to_int(x)


def compare(op: str, a: Column, kind_a: str, b: Column, kind_b: str) -> Column:
    """a op b: two texts by their bytes, otherwise as numbers."""
    kind = "str" if (kind_a, kind_b) == ("str", "str") else "int" if (kind_a, kind_b) == ("int", "int") else "float"
    a, b = as_kind(a, kind_a, kind), as_kind(b, kind_b, kind)
    if kind == "float" and op not in ("==", "!="):  # Spark orders NaN above all numbers
        sane = ~(F.isnan(a) | F.isnan(b))
    else:
        sane = F.lit(True)
    return {"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b, "==": a == b, "!=": a != b}[op] & sane
