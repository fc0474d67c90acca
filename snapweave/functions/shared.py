"""The folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only on one machine may it be unset, and checkpoints get a folder of our own."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="snapweave-")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(found)
    return found.rstrip("/")
