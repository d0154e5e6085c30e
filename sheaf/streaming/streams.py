"""The same operators on unbounded input, with Structured Streaming.

State is bounded by a watermark wherever it would grow with time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheaf.runtime import scratch, ship


def events_stream(spark, path: str, at: str = "ts") -> DataFrame:
    """The files of a folder as a stream, with event time as a timestamp."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).parquet(path)
    return df.withColumn(at, F.col(at).cast("timestamp"))


def histogram(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def tumbling(df: DataFrame, at: str, size: str, late: str, *keys: str, value: Column) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def sliding(df: DataFrame, at: str, size: str, step: str, late: str, *keys: str) -> DataFrame:
    return df.withWatermark(at, late).groupBy(F.window(at, size, step), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, at: str, gap: str, late: str, *keys: str) -> DataFrame:
    """Counts of sessions; a record a whole gap after the one before begins a new session, so windows end a microsecond early."""
    return df.withWatermark(at, late).groupBy(F.session_window(at, f"{gap} -1 microsecond"), *keys).agg(F.count("*").alias("n"))


def first_seen(df: DataFrame, at: str, late: str, *keys: str) -> DataFrame:
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))


def range_hits(df: DataFrame, key: str, order: str, start: Column, stop: Column) -> DataFrame:
    """Hits of a range pattern within each key, records of a batch taken in order; the state is one flag a key."""
    ship(df.sparkSession)
    marked = df.select(key, order, F.coalesce(start, F.lit(False)).alias("_start"), F.coalesce(stop, F.lit(False)).alias("_stop"))

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        inside = state.get[0] if state.exists else False
        rows = pd.concat(list(frames)).sort_values(order)
        hits = []
        for at, begins, ends in zip(rows[order], rows["_start"], rows["_stop"], strict=True):
            if inside or begins or ends:
                hits.append(at)
            inside = bool((inside or begins) and not ends)
        state.update((inside,))
        yield pd.DataFrame({key: [group[0]] * len(hits), order: hits})

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return marked.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}", "inside boolean", "append", GroupStateTimeout.NoTimeout)


def finished(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there now and return what it wrote.

    Both kinds of results are written as files to the checkpoint folder, where the
    state lies too. A complete result is written anew by each batch, beside that of
    the batch before; the last one counts.
    """
    spark = df.sparkSession
    home = f"{scratch(spark).rstrip('/')}/stream-{name}"
    if mode == "complete":
        written: list[str] = []

        def keep(batch: DataFrame, number: int) -> None:
            path = f"{home}/out/{number % 2}"
            batch.write.mode("overwrite").parquet(path)
            written.append(path)

        query = df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(df.schema).parquet(written[-1]) if written else spark.createDataFrame([], df.schema)
    query = df.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out").option("checkpointLocation", f"{home}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{home}/out")
