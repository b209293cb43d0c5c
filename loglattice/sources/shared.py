"""A folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, in a local session as in tests, below a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        key = spark.sparkContext.applicationId
        if key not in _own:
            _own[key] = "file://" + tempfile.mkdtemp(prefix="loglattice-")
        top = _own[key]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
