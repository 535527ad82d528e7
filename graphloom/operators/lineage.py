"""Cutting lineage in loops."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """The frame through a reliable checkpoint in the session's spark.checkpoint.dir. Only in local mode, where there is one
    machine, may that be unset."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        spark.sparkContext.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), "graphloom-checkpoint"))
    return df.checkpoint(eager=True)
