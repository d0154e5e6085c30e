"""Making this package importable where Python code runs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    home = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="sheaf-src-")) / "sheaf.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, str(Path(home.name) / p.relative_to(home)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local one is set only where none is named and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sheaf-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get()


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet in the checkpoint folder and read again: its rows are fixed from then on."""
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/sheaf-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
