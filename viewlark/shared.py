"""The folder that driver and executors share: ``spark.checkpoint.dir``, and one of our own only where that is unset, in a local session.

``llm/common.py`` does the same for its part, as neither may need the other.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """A new place in it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="viewlark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/viewlark-{uuid.uuid4().hex}"
