"""Scratch folders that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Only where the session names no folder and all tasks run on one machine, as in local tests.
LOCAL_DEFAULT = "/tmp/checkpoints/chronolith"


def scratch(spark: SparkSession, name: str) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and hasattr(spark, "_jsc"):
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_DEFAULT
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
