"""Working tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a local session gets a fresh folder; on a cluster that would scatter working tables
    over machines, so it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="presswave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    folder = f"{shared_dir(spark)}/presswave-{uuid.uuid4().hex[:12]}"
    _made.append(folder)
    return f"{folder}/{name}"


def drop_working_tables(spark: SparkSession) -> int:
    """Delete the working tables of this process and tell how many folders went; results read from them are gone too."""
    gone = 0
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))
    return gone


def materialize(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Unlike localCheckpoint the copy outlives executors, and unlike checkpoint() the input is computed once.
    ``batch``: at most so many rows go to Python at once in this write (Spark bounds their bytes anyhow).
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    if batch:
        spark.conf.set(setting, str(min(batch, int(before)) if int(before) > 0 else batch))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(df.schema).parquet(path)
