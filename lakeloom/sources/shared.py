"""Cutting the lineage of iterations, in the folder that the session names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and written to the checkpoint folder. Only a local session without that folder (a test) gets a
    temporary one."""
    session = df.sparkSession
    context = session.sparkContext
    if context.getCheckpointDir() is None:
        folder = session.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="lakeloom-")
        context.setCheckpointDir(folder)
    return df.checkpoint()
