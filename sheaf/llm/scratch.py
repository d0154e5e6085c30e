"""Tables cut from their lineage, in the folder the session names for checkpoints.

They lie in one folder for each application, which Hadoop deletes when the
application ends; those that a later one replaces are discarded before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sheaf.runtime import scratch

_marked: set[str] = set()


def _path(spark: SparkSession, name: str):
    """(file system, path) in Hadoop's terms."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder(spark: SparkSession) -> str:
    """This application's folder in the shared checkpoint folder of the session."""
    own = f"{scratch(spark).rstrip('/')}/sheaf-{spark.sparkContext.applicationId}"
    if own not in _marked:
        system, path = _path(spark, own)
        system.mkdirs(path)
        system.deleteOnExit(path)
        _marked.add(own)
    return own


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the checkpoint folder and read it again."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that stash returned and that nothing will read again."""
    for t in tables:
        system, path = _path(t.sparkSession, t._stashed_at)
        system.delete(path, True)
