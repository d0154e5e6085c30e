"""Records to files: lines, CSV and TSV with the escapes that the readers read back, and a file for each target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import escape_csv, escape_tsv


def joined(*values: Column, separator: str = " ") -> Column:
    """What print writes: texts with a separator between; null as empty."""
    return F.concat_ws(separator, *[F.coalesce(v.cast("string"), F.lit("")) for v in values])


def csv_line(*values: Column) -> Column:
    return joined(*[escape_csv(F.coalesce(v.cast("string"), F.lit(""))) for v in values], separator=",")


def tsv_line(*values: Column) -> Column:
    return joined(*[escape_tsv(F.coalesce(v.cast("string"), F.lit(""))) for v in values], separator="\t")


def write_lines(df: DataFrame, line: Column, path: str, append: bool = False, ending: str = "\n") -> None:
    df.select(line.alias("value")).write.mode("append" if append else "overwrite").option("lineSep", ending).text(path)


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    write_lines(df, csv_line(*[F.col(f"`{c}`") for c in df.columns]), path, append, "\r\n")


def write_tsv(df: DataFrame, path: str, append: bool = False) -> None:
    write_lines(df, tsv_line(*[F.col(f"`{c}`") for c in df.columns]), path, append)


def write_targets(df: DataFrame, line: Column, target: Column, path: str, append: bool = False) -> None:
    """A folder target=... for each name that target gives, in one pass."""
    df.select(line.alias("value"), target.alias("target")).write.mode("append" if append else "overwrite").partitionBy("target").text(path)
