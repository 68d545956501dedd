"""A folder for files that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``; under a temporary folder where that is unset and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="matrel-files-")
        _own[context.applicationId] = found
    return f"{found.rstrip('/')}/matrel-{name}-{uuid.uuid4().hex}"
