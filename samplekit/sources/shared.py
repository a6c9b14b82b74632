"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where the session names none, one below a temporary folder, on a local master alone: other machines don't have it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("the session must name a shared folder in spark.checkpoint.dir")
        base = tempfile.gettempdir()
    return f"{base}/{uuid.uuid4().hex}"
