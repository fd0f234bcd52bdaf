"""Reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The context's checkpoint folder, set from spark.checkpoint.dir where it isn't yet. Where none is named, a session on
    this machine alone (as in tests) takes a temporary one; on a cluster that would lose data with a machine, so it is an
    error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """df checkpointed in the session's checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
