"""Cutting long lineages into the checkpoint folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def pinned(df: DataFrame) -> DataFrame:
    """Computes df once into the folder of spark.checkpoint.dir; where it is unset, a local master gets one of its own and a cluster is refused."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
            at = tempfile.mkdtemp(prefix="checkpoint")
            atexit.register(shutil.rmtree, at, True)
        sc.setCheckpointDir(at)
    return df.checkpoint(eager=True)
