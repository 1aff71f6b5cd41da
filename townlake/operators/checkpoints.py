"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for results that outlive an executor: ``spark.checkpoint.dir`` of the session.

    Where that is unset (a local session, as in tests) a temporary folder serves; on a cluster
    that would be a machine's own disk, so there the setting is asked for.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="townlake-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, and cut its lineage there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
