"""A folder that all executors share, for state and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; where that is unset, one of this machine's if Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    base = base or f"file://{tempfile.mkdtemp(prefix='twinsift-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
