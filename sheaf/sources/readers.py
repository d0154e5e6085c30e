"""Records from files: lines with their file and place, fields, CSV, TSV and headers.

Lines are read by Spark's splittable text source. Quoted CSV is splittable as
well unless newlines may be quoted, which the caller must say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import split_fields, unescape


def lines(spark: SparkSession, paths: str | list[str], separator: str = "\n") -> DataFrame:
    """A row for each record: file, pos (increasing within a file), line. separator: literal text between records."""
    paths = [paths] if isinstance(paths, str) else paths
    raw = spark.read.option("lineSep", separator).text(paths)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return raw.select(F.col("_metadata.file_path").alias("file"), at.alias("pos"), F.col("value").alias("line"))


def records(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """Records that a regular expression separates; a file is read as a whole, so this is for files that fit a task."""
    paths = [paths] if isinstance(paths, str) else paths
    whole = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", f"(?:{pattern})\\z", "").alias("value"))
    return whole.select("file", F.posexplode(F.split("value", pattern)).alias("pos", "line"))


def with_fields(df: DataFrame, separator: str = " ", line: str = "line", name: str = "fields", at_most: int | None = None) -> DataFrame:
    """df with the fields of a line; at_most: the highest field needed, beyond which nothing is split."""
    return df.withColumn(name, split_fields(F.col(line), separator, at_most))


def tsv_fields(line: Column) -> Column:
    r"""Fields between tabs, with \t, \n and \\ read back."""
    return F.transform(split_fields(line, "\t"), unescape)


#: Possessive, so that long fields take no stack.
_CSV_FIELD = r'("(?:[^"]++|"")*+"|[^,]*+),'


def csv_fields(line: Column) -> Column:
    """Fields of one CSV line: quotes taken off, doubled ones single, escapes inside quotes read back."""
    body = F.regexp_replace(line, "\r$", "")
    parts = F.regexp_extract_all(F.concat(body, F.lit(",")), F.lit(_CSV_FIELD), F.lit(1))

    def plain(x):
        inner = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
        return F.when(x.startswith('"') & x.endswith('"') & (F.length(x) >= 2), unescape(inner)).otherwise(x)

    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.transform(parts, plain))


def csv(spark: SparkSession, paths: str | list[str], header: bool = False, quoted_newlines: bool = False, backslash_escapes: bool = False, separator: str = ",") -> DataFrame:
    r"""A table of text columns, named by the header or _c0, _c1, ...

    backslash_escapes: \t, \n and \\ are read back (in unquoted fields too).
    """
    df = spark.read.csv(paths, sep=separator, header=header, quote='"', escape='"', multiLine=quoted_newlines, mode="PERMISSIVE", nullValue=None, emptyValue="")
    df = df.na.fill("")
    return df.select(*[unescape(F.col(f"`{c}`")).alias(c) for c in df.columns]) if backslash_escapes else df


def tsv(spark: SparkSession, paths: str | list[str], columns: int) -> DataFrame:
    """A table of text columns _c0 to _c{columns - 1} from tab-separated lines; missing fields are empty."""
    df = lines(spark, paths).select(tsv_fields(F.col("line")).alias("f"))
    return df.select(*[F.coalesce(F.get("f", k), F.lit("")).alias(f"_c{k}") for k in range(columns)])


def valid_utf8(df: DataFrame, column: str = "line") -> DataFrame:
    """df, failing at run time on text that is not UTF-8."""
    return df.withColumn(column, F.validate_utf8(column))
