"""Session helpers: settings every operator relies on, and safe lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split hot keys even where that costs one more shuffle further on
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # shuffle files go with the action that made them, not when the driver happens to collect
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators assume (UTC, adaptive execution)."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the checkpoint
    folder that was set by program. A temporary folder stands in on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="postwatch-")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names.

    ``spark.checkpoint.dir`` is shared storage on a cluster, so the result survives the loss of
    executors. Where neither it nor a programmatic folder is set, a local master gets a temporary
    folder and any other an error.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder, and read from there: as safe as
    :func:`cut_lineage` and a fraction of its size. Types that Parquet has not are checkpointed."""
    kinds = df.schema.simpleString()
    if "void" in kinds or "interval" in kinds:
        return cut_lineage(df)
    folder = new_folder(df.sparkSession, name)
    if (known := _FOLDERS.get()) is not None:
        known.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def dropping_written(spark: SparkSession) -> Iterator[None]:
    """What is :func:`written` inside is deleted at the end; nothing may read it later."""
    folders: list[str] = []
    token = _FOLDERS.set(folders)
    try:
        yield
    finally:
        _FOLDERS.reset(token)
        for folder in folders:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
