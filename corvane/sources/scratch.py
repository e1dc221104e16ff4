"""A folder that all executors share: under spark.checkpoint.dir where that is set, else, in a local session (tests), a temporary one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    return f"{shared}/{name}-{uuid.uuid4().hex}" if shared else f"file://{tempfile.mkdtemp(prefix='spark-')}/{name}"
