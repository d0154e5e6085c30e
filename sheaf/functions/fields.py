"""Fields of a record: $n, NF, assignment and joins of a range of fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.text import escape_csv, escape_tsv


def count(fields: Column) -> Column:
    return F.size(fields).cast("bigint")


def nth(fields: Column, n: Column | int) -> Column:
    """The n-th field (1-based), empty if there is none; n below 1 is an error at run time."""
    n = n if isinstance(n, Column) else F.lit(n)
    wrong = F.raise_error(F.lit("a field's number must be positive"))
    return F.when(n < 1, wrong.cast("string")).otherwise(F.coalesce(F.get(fields, (n - 1).cast("int")), F.lit("")))


def assign(fields: Column, n: int, value: Column) -> Column:
    """The fields with the n-th replaced, extended with empty ones where needed."""
    size = F.greatest(F.size(fields), F.lit(n))
    return F.transform(F.sequence(F.lit(1), size), lambda i: F.when(i == n, value).otherwise(F.coalesce(F.get(fields, i - 1), F.lit(""))))


def rebuild(fields: Column, separator: str = " ") -> Column:
    return F.array_join(fields, separator)


def _between(fields: Column, i: int, j: int) -> Column:
    if i < 1 or j < 1:
        raise ValueError("fields are numbered from 1")
    return F.slice(fields, i, max(0, j - i + 1))


def join_fields(fields: Column, i: int, j: int, separator: str = " ") -> Column:
    """Fields i to j, j clamped to their number."""
    return F.array_join(_between(fields, i, j), separator)


def join_csv(fields: Column, i: int, j: int) -> Column:
    return F.array_join(F.transform(_between(fields, i, j), escape_csv), ",")


def join_tsv(fields: Column, i: int, j: int) -> Column:
    return F.array_join(F.transform(_between(fields, i, j), escape_tsv), "\t")
