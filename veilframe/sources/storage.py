"""Cutting lineage in a way that survives lost executors."""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder the cluster names, if there is one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; in a session of one process that names none (as in tests), a temporary one."""
    folder = checkpoint_dir(spark)
    if folder is None:
        if not _one_process(spark):
            raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="veilframe-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _one_process(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def pinned(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, from the shared checkpoint folder.

    Where the session names none and runs in one process (as in tests), a local
    temporary folder serves; on a cluster without one the rows are persisted.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if checkpoint_dir(spark) is None and not _one_process(spark):
            return df.persist(StorageLevel.MEMORY_AND_DISK)
        sc.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)
