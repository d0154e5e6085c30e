"""Operators of order against windows, over many partitions, with a hot key, null keys and null values."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sheaf.operators import ordered


@pytest.fixture
def rows(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # borders stay where they are
    rng = random.Random(5)
    data = [(i, rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, 1, 2, 3]), rng.choice(["x", "y", None])) for i in range(400)]
    rng.shuffle(data)
    yield spark.createDataFrame(data, "i int, k string, v int, t string")
    spark.conf.unset("spark.sql.adaptive.enabled")


def same(got, want):
    cols = sorted(want.columns)
    show = lambda df: sorted(map(repr, df.select(*cols).collect()))
    assert show(got) == show(want)


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_against_windows(rows, keys):
    w = Window.partitionBy(*(keys or [])).orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    assert ordered.Ordered(rows, ["i"], keys).rows.select("_part").distinct().count() > 2
    same(ordered.record_number(rows, ["i"], keys), rows.withColumn("nr", F.row_number().over(w)))
    same(ordered.running_total(rows, ["i"], F.col("v"), keys), rows.withColumn("total", F.coalesce(F.sum("v").over(upto), F.lit(0))))
    same(ordered.previous_record(rows, ["i"], F.col("t"), keys, default="D"), rows.withColumn("previous", F.lag("t", 1, "D").over(w)))
    same(ordered.next_record(rows, ["i"], F.col("t"), keys, default="D"), rows.withColumn("following", F.lead("t", 1, "D").over(w)))
    start, stop = F.col("i") % 50 == 3, F.col("i") % 50 == 40
    open_ = F.last(F.when(stop, 0).when(start, 1), ignorenulls=True).over(before) == 1
    want = rows.withColumn("o", F.coalesce(open_, F.lit(False))).where(F.col("o") | start | stop).drop("o")
    same(ordered.range_pattern(rows, ["i"], start, stop, keys), want)


def test_until_skip_and_nth(rows):
    w = Window.partitionBy("k").orderBy("i")
    fired = F.coalesce(F.max((F.col("i") > 350).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same(ordered.until(rows, ["i"], F.col("i") > 350, ["k"]), rows.withColumn("f", fired).where("f = 0").drop("f"))
    same(ordered.skip_first(rows, ["i"], 3, ["k"]), rows.withColumn("n", F.row_number().over(w)).where("n > 3").drop("n"))
    same(ordered.every_nth(rows, ["i"], 7, 2, ["k"]), rows.withColumn("n", F.row_number().over(w)).where("n % 7 = 2").drop("n"))


@pytest.mark.parametrize("keys", [None, ["k"]])
def test_control_break(rows, keys):
    got = ordered.control_break(rows.na.fill("-", ["t"]), ["i"], F.col("t"), F.col("v"), keys)
    want, last = {}, {}
    for r in sorted(rows.collect(), key=lambda r: r.i):
        at, t = (r.k if keys else 0), r.t or "-"
        run, was = last.get(at, (0, t))
        run += was != t
        last[at] = run, t
        n, total = want.get((at, run, t), (0, None))
        want[at, run, t] = n + 1, total if r.v is None else (total or 0) + r.v
    assert {((r.k if keys else 0), r.run, r.key): (r.n, r.total) for r in got.collect()} == want


def test_empty(rows):
    assert ordered.record_number(rows.limit(0), ["i"], ["k"]).count() == 0
    assert ordered.control_break(rows.limit(0), ["i"], F.col("t"), F.col("v")).count() == 0
