import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import ordered
from sheaf.sources import readers, sinks


@pytest.mark.parametrize("classic", [False, True])
def test_global_ranges_against_a_state_machine(spark, classic):
    rng = random.Random(4)
    rows = [(i, rng.choice("abcc")) for i in range(500)]
    want, inside = [], False
    for i, c in rows:
        if inside or c == "a" or (c == "b" and not classic):
            want.append(i)
        inside = (inside or c == "a") and c != "b"
    df = spark.createDataFrame(rows, "i int, c string").repartition(7)
    got = ordered.range_pattern(df, ["i"], F.col("c") == "a", F.col("c") == "b", classic=classic)
    assert sorted(r.i for r in got.collect()) == want


def test_numbers_totals_and_neighbours(spark):
    df = spark.createDataFrame([(i, i * i % 7) for i in range(300)], "i int, v int").repartition(5)
    assert [r.nr for r in ordered.record_number(df, ["i"]).orderBy("i").collect()] == list(range(1, 301))
    totals, s = [], 0
    for i in range(300):
        s += i * i % 7
        totals.append(s)
    assert [r.total for r in ordered.running_total(df, ["i"], F.col("v")).orderBy("i").collect()] == totals
    assert [r.previous for r in ordered.previous_record(df, ["i"], F.col("i"), default=-1).orderBy("i").collect()] == list(range(-1, 299))
    assert [r.following for r in ordered.next_record(df, ["i"], F.col("i"), default=-1).orderBy("i").collect()] == [*range(1, 300), -1]


def test_csv_round_trip(spark, tmp_path):
    rows = [("a,b", 'say "hi"', "x\ty"), ("", "plain", "two\nlines"), ("é", "", "z")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    path = f"file://{tmp_path}/csv"
    sinks.write_csv(df, path)
    back = readers.csv(spark, path, backslash_escapes=True)
    assert sorted(tuple(r) for r in back.collect()) == sorted(rows)
    sinks.write_tsv(df, f"{path}-tsv")
    assert sorted(tuple(r) for r in readers.tsv(spark, f"{path}-tsv", 3).collect()) == sorted(rows)


def test_records_by_pattern_and_fields(spark, tmp_path):
    (tmp_path / "f.txt").write_text("one two\n\nthree  four five\n\nsix")
    df = readers.records(spark, f"file://{tmp_path}/f.txt", "\n\n+")
    got = readers.with_fields(df).orderBy("pos").select("fields").collect()
    assert [r.fields for r in got] == [["one", "two"], ["three", "four", "five"], ["six"]]


def test_lines_have_file_and_place(spark, tmp_path):
    (tmp_path / "a").write_text("1\n2\n")
    (tmp_path / "b").write_text("3\n")
    df = readers.lines(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"])
    assert [r.line for r in df.orderBy("file", "pos").collect()] == ["1", "2", "3"]


def test_targets(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3)], "t string, v int")
    sinks.write_targets(df, sinks.joined(F.col("v")), F.col("t"), f"file://{tmp_path}/out")
    got = spark.read.text(f"file://{tmp_path}/out").groupBy("target").count().collect()
    assert {r.target: r["count"] for r in got} == {"x": 2, "y": 1}


def test_neighbours_at_borders_may_be_null(spark):
    """A null value of a neighbour in another partition is not the same as no neighbour."""
    df = spark.range(200).select("id", F.lit(None).cast("string").alias("v")).repartition(4)
    for f in (ordered.previous_record, ordered.next_record):
        got = f(df, ["id"], F.col("v"), name="x", default="D").collect()
        assert sum(r.x == "D" for r in got) == 1 and sum(r.x is None for r in got) == 199
