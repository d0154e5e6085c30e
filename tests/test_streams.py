import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from sheaf.runtime import scratch
from sheaf.streaming import streams


def _stream(spark, path):
    return spark.readStream.schema("user long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))


def _put(spark, path, rows):
    spark.createDataFrame(rows, "user long, ts timestamp").coalesce(1).write.mode("append").parquet(str(path))


def _at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_complete_results_are_files_of_the_last_batch(spark, tmp_path):
    """The memory sink brought all rows of all batches to the driver."""
    for k in range(3):
        _put(spark, tmp_path, [(u, _at(60 * k)) for u in range(20 * (k + 1))])
    name = f"sessions_{uuid.uuid4().hex[:12]}"
    out = streams.finished(streams.sessions(_stream(spark, tmp_path), "ts", "30 minutes", "10 days", "user"), name)
    assert out.inputFiles() and all(scratch(spark).removeprefix("file:") in f for f in out.inputFiles())
    assert not spark.catalog.tableExists(name)
    assert sorted((r.user, r.session_window.start, r.n) for r in out.collect()) == sorted((u, _at(60 * k), 1) for k in range(3) for u in range(20 * (k + 1)))


@pytest.mark.parametrize("files", [0, 1])
def test_complete_results_of_no_records(spark, tmp_path, files):
    for _ in range(files):
        _put(spark, tmp_path, [])
    out = streams.finished(streams.histogram(_stream(spark, tmp_path), "user"), f"none_{uuid.uuid4().hex[:12]}")
    assert out.columns == ["user", "n"] and out.collect() == []


def test_a_whole_gap_ends_a_session(spark, tmp_path):
    short = _at(30) - dt.timedelta(microseconds=1)
    _put(spark, tmp_path, [(1, _at(0)), (1, _at(30)), (2, _at(0)), (2, short), (2, short), (3, _at(5))])
    out = streams.finished(streams.sessions(_stream(spark, tmp_path), "ts", "30 minutes", "10 minutes", "user"), f"gap_{uuid.uuid4().hex[:12]}")
    got = out.select("user", F.col("session_window.start").alias("at"), "n").collect()
    assert sorted(map(tuple, got)) == [(1, _at(0), 1), (1, _at(30), 1), (2, _at(0), 3), (3, _at(5), 1)]
