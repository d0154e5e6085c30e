"""Operators that depend on record order, without sending all records to one task.

Records are sorted by range into partitions that are written once; each is
handled by itself, and what crosses a border (a count, a sum, the last record or
state before it) is one row for each partition, joined back by broadcast: its
size is the number of partitions, whatever the data. With partition_by the order
holds within each key: records are sorted by key first, so that a key with a
third of all records is spread as well, and only the last key of a partition can
go on in the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.runtime import written

_PART, _AT = "_part", "_at"


class Ordered:
    """Records in the order of given columns, all or key by key, placed within range partitions."""

    def __init__(self, df: DataFrame, order_by: list[str], keys: list[str] | None = None) -> None:
        self.columns, self.keys = df.columns, list(keys or [])
        by = [*self.keys, *order_by]
        sorted_ = df.repartitionByRange(*by).sortWithinPartitions(*by)
        place = F.monotonically_increasing_id()
        self.rows = written(sorted_.select("*", F.shiftright(place, 33).cast("int").alias(_PART), place.bitwiseAND(F.lit((1 << 33) - 1)).alias(_AT)))
        #: A key's records in one partition, in order.
        self.here = Window.partitionBy(_PART, *self.keys).orderBy(_AT)
        self.upto = self.here.rowsBetween(Window.unboundedPreceding, 0)
        self.before = self.here.rowsBetween(Window.unboundedPreceding, -1)
        #: A key's partitions, in order: one row for each.
        self.parts = Window.partitionBy(*self.keys).orderBy(_PART)
        self.earlier = self.parts.rowsBetween(Window.unboundedPreceding, -1)

    def _borders(self, **values: Column) -> DataFrame:
        return self.rows.groupBy(_PART, *self.keys).agg(*[v.alias(k) for k, v in values.items()])

    def _with(self, borders: DataFrame, carried: Column, *more: str) -> DataFrame:
        """Rows with what another partition says of their key as _carried, null where no other has the key."""
        names = [(k, f"_key{i}") for i, k in enumerate(self.keys)]
        found = borders.select(_PART, *more, *[F.col(k).alias(n) for k, n in names], carried.alias("_found")).where("_found is not null")
        same = F.lit(True)
        for k, n in names:
            same = same & F.col(k).eqNullSafe(F.col(n))
        rows = self.rows.join(F.broadcast(found), _PART, "left")  # at most one row for each partition: that of its first or last key
        return rows.withColumn("_carried", F.when(same, F.col("_found")))

    def number(self, name: str = "nr") -> DataFrame:
        borders = self._borders(n=F.count("*"))
        own = F.row_number().over(self.here) if self.keys else F.col(_AT) + 1
        rows = self._with(borders, F.sum("n").over(self.earlier))
        return rows.select(*self.columns, (F.coalesce("_carried", F.lit(0)) + own).cast("bigint").alias(name))

    def running_sum(self, value: Column, name: str = "total") -> DataFrame:
        rows = self._with(self._borders(n=F.sum(value)), F.sum("n").over(self.earlier))
        own = F.sum(value).over(self.upto)
        return rows.select(*self.columns, (F.coalesce("_carried", F.lit(0)) + F.coalesce(own, F.lit(0))).alias(name))

    def previous(self, value: Column, name: str = "previous", default=None) -> DataFrame:
        borders = self._borders(v=F.max_by(F.struct(value.alias("x")), _AT))  # a struct tells a null value from no record
        rows = self._with(borders, F.lag("v").over(self.parts))
        own = F.lag(F.struct(value.alias("x"))).over(self.here)
        return rows.select(*self.columns, _value(F.coalesce(own, "_carried"), default).alias(name))

    def following(self, value: Column, name: str = "following", default=None) -> DataFrame:
        borders = self._borders(v=F.min_by(F.struct(value.alias("x")), _AT))
        rows = self._with(borders, F.lead("v").over(self.parts))
        own = F.lead(F.struct(value.alias("x"))).over(self.here)
        return rows.select(*self.columns, _value(F.coalesce(own, "_carried"), default).alias(name))

    def ranges(self, start: Column, stop: Column, classic: bool = False, name: str = "in_range") -> DataFrame:
        state = F.when(stop, 0).when(start, 1)
        borders = self._borders(v=F.max_by(state, F.when(state.isNotNull(), F.col(_AT))))
        rows = self._with(borders, F.last("v", ignorenulls=True).over(self.earlier))
        open_ = F.coalesce(F.last(state, ignorenulls=True).over(self.before), "_carried") == 1
        return rows.withColumn("_open", F.coalesce(open_, F.lit(False))).select(*self.columns, _hit(start, stop, classic).alias(name))

    def fired(self, test: Column, name: str = "fired") -> DataFrame:
        """Rows with whether an earlier record of the key meets a test."""
        hit = F.coalesce(test, F.lit(False))
        rows = self._with(self._borders(v=F.bool_or(hit)), F.bool_or("v").over(self.earlier))
        own = F.bool_or(hit).over(self.before)
        return rows.select(*self.columns, (F.coalesce("_carried", F.lit(False)) | F.coalesce(own, F.lit(False))).alias(name))


def _value(found: Column, default) -> Column:
    return F.when(found.isNull(), F.lit(default)).otherwise(found["x"])


def _hit(start: Column, stop: Column, classic: bool) -> Column:
    hit = F.coalesce(start, F.lit(False)) | F.col("_open")
    return hit if classic else hit | F.coalesce(stop, F.lit(False))


def record_number(df: DataFrame, order_by: list[str], partition_by: list[str] | None = None, name: str = "nr") -> DataFrame:
    """df with each record's number from 1, over all records or within each key."""
    return Ordered(df, order_by, partition_by).number(name)


def running_total(df: DataFrame, order_by: list[str], value: Column, partition_by: list[str] | None = None, name: str = "total") -> DataFrame:
    """df with the sum of a value over the records up to each; nulls add nothing."""
    return Ordered(df, order_by, partition_by).running_sum(value, name)


def previous_record(df: DataFrame, order_by: list[str], value: Column, partition_by: list[str] | None = None, name: str = "previous", default=None) -> DataFrame:
    """df with a value of the record before each."""
    return Ordered(df, order_by, partition_by).previous(value, name, default)


def next_record(df: DataFrame, order_by: list[str], value: Column, partition_by: list[str] | None = None, name: str = "following", default=None) -> DataFrame:
    """df with a value of the record after each."""
    return Ordered(df, order_by, partition_by).following(value, name, default)


def range_flag(df: DataFrame, order_by: list[str], start: Column, stop: Column, classic: bool = False, name: str = "in_range", partition_by: list[str] | None = None) -> DataFrame:
    """df with whether a record is in a range, as range_pattern says."""
    return Ordered(df, order_by, partition_by).ranges(start, stop, classic, name)


def range_pattern(df: DataFrame, order_by: list[str], start: Column, stop: Column, partition_by: list[str] | None = None, classic: bool = False) -> DataFrame:
    """Records from one that meets start to the next that meets stop, both included.

    A record that meets only stop, with no range open, is a hit as well, unless classic.
    """
    return range_flag(df, order_by, start, stop, classic, "_hit", partition_by).where("_hit").drop("_hit")


def until(df: DataFrame, order_by: list[str], fired: Column, partition_by: list[str]) -> DataFrame:
    """Of each key (a file), the records up to the first that fires, it included: what skipping to the next file leaves."""
    return Ordered(df, order_by, partition_by).fired(fired, "_fired").where("not _fired").drop("_fired")


def every_nth(df: DataFrame, order_by: list[str], n: int, offset: int = 0, partition_by: list[str] | None = None) -> DataFrame:
    """Records whose number leaves offset when divided by n."""
    return record_number(df, order_by, partition_by, "_nr").where(F.col("_nr") % n == offset).drop("_nr")


def first_n(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def skip_first(df: DataFrame, order_by: list[str], n: int, partition_by: list[str]) -> DataFrame:
    """Each key's records without the first n (header lines)."""
    return record_number(df, order_by, partition_by, "_nr").where(F.col("_nr") > n).drop("_nr")


def control_break(df: DataFrame, order_by: list[str], key: Column, value: Column, partition_by: list[str] | None = None) -> DataFrame:
    """Subtotals of runs of equal keys, over all records or within partition_by: a row for each run with its keys, run number, count and total."""
    within = list(partition_by or [])
    known = previous_record(df, order_by, key, within, "_was")
    runs = running_total(known, order_by, F.coalesce((key != F.col("_was")).cast("bigint"), F.lit(0)), within, "run")
    return runs.groupBy(*within, "run", key.alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
