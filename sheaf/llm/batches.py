"""Arrow batches on the executors: the package sent along, bounded batches, memory given back, and names that cannot clash."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from sheaf.llm import words
from sheaf.runtime import ship

#: Rows of an Arrow batch, unless the session sets another number: texts may be long, and the JVM and Python each hold a batch.
BATCH_ROWS = 1_000

Batches = Iterator[pa.RecordBatch]


def _bounded(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None and spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a task used back to the system: Python workers are used again by later tasks."""
    words.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not that C library
        pass


def released(f: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def mapped(df: DataFrame, f: Callable[[Batches], Batches], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(f, schema), where executors need not have this package."""
    ship(df.sparkSession)
    _bounded(df.sparkSession)
    return df.mapInArrow(released(f), schema)


def plainly(docs: DataFrame, replaced: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """docs with its columns named c0, c1, ... and their own names; columns that will be replaced are dropped first.

    No name of the caller's can clash with one that an operation uses itself.
    """
    gone = {x.lower() for x in replaced}
    at = [i for i, c in enumerate(docs.columns) if c.lower() not in gone]
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).select(*[f"c{i}" for i in at])
    return named.toDF(*[f"c{i}" for i in range(len(at))]), [docs.columns[i] for i in at]


def place(names: list[str], column: str) -> str:
    """The plain name of the caller's column."""
    if column in names:
        return f"c{names.index(column)}"
    lower = [n.lower() for n in names]
    if column.lower() not in lower:
        raise ValueError(f"there is no column {column!r}")
    return f"c{lower.index(column.lower())}"


def ddl(schema: StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
