"""Lookups between tables, as associative arrays are used for joins.

Which side is sent to the tasks is left to Spark, which knows sizes at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.operators.keyed import last_write
from sheaf.operators.ordered import record_number


def _dictionary(dim: DataFrame, key: str, value: str, at: str) -> DataFrame:
    return last_write(dim, key, F.col(value), F.col(at), "_value").withColumnRenamed(key, "_key")


def inner(fact: DataFrame, on: str, dim: DataFrame, key: str, value: str, at: str, name: str) -> DataFrame:
    """Facts whose key was written, with the value last written for it."""
    d = _dictionary(dim, key, value, at)
    return fact.join(d, fact[on] == d["_key"]).drop("_key").withColumnRenamed("_value", name)


def left_default(fact: DataFrame, on: str, dim: DataFrame, key: str, value: str, at: str, name: str, default) -> DataFrame:
    """All facts; the default where the key was never written."""
    d = _dictionary(dim, key, value, at)
    return fact.join(d, fact[on] == d["_key"], "left").withColumn(name, F.coalesce("_value", F.lit(default))).drop("_key", "_value")


def semi(fact: DataFrame, on: str, dim: DataFrame, key: str) -> DataFrame:
    return fact.join(dim, fact[on] == dim[key], "left_semi")


def anti(fact: DataFrame, on: str, dim: DataFrame, key: str) -> DataFrame:
    return fact.join(dim, fact[on] == dim[key], "left_anti")


def theta(a: DataFrame, b: DataFrame, condition: Column) -> DataFrame:
    """Pairs that meet a condition: loops within loops. Equalities in it let Spark hash."""
    return a.join(b, condition)


def positional(a: DataFrame, order_a: list[str], b: DataFrame, order_b: list[str]) -> DataFrame:
    """The n-th record of one table with the n-th of the other; records without a partner are left out."""
    return record_number(a, order_a, name="nr").join(record_number(b, order_b, name="nr"), "nr")
