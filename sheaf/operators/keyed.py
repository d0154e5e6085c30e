"""Keyed counters, sums and choices: one partial and one final aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram(df: DataFrame, *keys: str | Column, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def keyed_sum(df: DataFrame, *keys: str | Column, value: Column, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def keyed_product(df: DataFrame, *keys: str | Column, value: Column, name: str = "product", **sums: Column) -> DataFrame:
    """What m[k] *= value leaves of 1 (a null value changes nothing), with sums beside it."""
    return df.groupBy(*keys).agg(F.coalesce(F.product(value), F.lit(1.0)).alias(name), *[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])


def keyed_mean(df: DataFrame, *keys: str | Column, value: Column, name: str = "mean") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def global_sum(df: DataFrame, **values: Column) -> DataFrame:
    """Sums that are 0 over no records."""
    return df.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in values.items()])


def column_statistics(df: DataFrame, **values: Column) -> DataFrame:
    """Count, minimum, maximum, mean and sample deviation of each value, in one pass."""
    out = []
    for k, v in values.items():
        out += [F.count(v).alias(f"{k}_n"), F.min(v).alias(f"{k}_min"), F.max(v).alias(f"{k}_max"), F.avg(v).alias(f"{k}_mean"), F.stddev_samp(v).alias(f"{k}_dev")]
    return df.agg(*out)


def argmax_first(df: DataFrame, value: Column, at: Column, *take: Column, keys: list[str | Column] | None = None) -> DataFrame:
    """Columns of the record with the largest value; of equal ones, the first by place."""
    best = F.max_by(F.struct(value.alias("_value"), *take), F.struct(value, -at)).alias("_best")
    return df.groupBy(*(keys or [])).agg(best).select(*(keys or []), "_best.*").drop("_value")


def first_seen(df: DataFrame, keys: list[str], at: Column, *take: Column) -> DataFrame:
    """The first record of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*take), at).alias("_first")).select(*keys, "_first.*")


def last_write(df: DataFrame, key: str, value: Column, at: Column, name: str = "value") -> DataFrame:
    """What an associative array holds in the end: each key's last value."""
    return df.groupBy(key).agg(F.max_by(value, at).alias(name))


def ordered_concat(df: DataFrame, keys: list[str], value: Column, at: Column, separator: str = " ", name: str = "joined") -> DataFrame:
    """Texts of each key joined in order of place."""
    pairs = F.array_sort(F.collect_list(F.struct(at.alias("at"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda x: x["v"]), separator).alias(name))


def any_nonempty(df: DataFrame, keys: list[str], value: Column, name: str = "value") -> DataFrame:
    """How texts of several workers merge: any that is not empty (here the largest, to be repeatable), else empty."""
    return df.groupBy(*keys).agg(F.coalesce(F.max(F.nullif(value, F.lit(""))), F.lit("")).alias(name))


def distinct_count(df: DataFrame, *values: Column, approximate: bool = False, name: str = "n") -> DataFrame:
    return df.agg((F.approx_count_distinct(*values) if approximate else F.count_distinct(*values)).alias(name))


def partial_totals(df: DataFrame, slots: int, salt: Column, **values: Column) -> DataFrame:
    """A row for each of `slots` workers' shares of the records, numbered from 1, to be merged by any rule."""
    pid = (F.pmod(salt, F.lit(slots)) + 1).cast("bigint").alias("pid")
    return df.groupBy(pid).agg(*[v.alias(k) for k, v in values.items()])
