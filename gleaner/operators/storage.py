"""Tables that cut lineage: written below the checkpoint folder that the whole cluster shares, and read again."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def use_checkpoints(spark: SparkSession) -> None:
    """Keeps the cluster's spark.checkpoint.dir; sets an own folder only in local mode, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="checkpoints-")
    context.setCheckpointDir(folder)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder."""
    use_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4()}"


def written(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows as a Parquet table below the checkpoint folder, and its path.

    Unlike ``checkpoint()``, which keeps the size estimate of the plan behind it, the result's size is that of its files: estimates of
    iterated joins don't multiply, and small tables are broadcast.
    """
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later plan reads."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Deletes the shuffle files of every job that runs inside as soon as its result is there.

    Otherwise they lie on the executors' disks until the driver happens to collect the plans that refer to them.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
