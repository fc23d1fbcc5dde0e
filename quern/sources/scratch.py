"""Folders for tables that live as long as the driver."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from quern.errors import ConfigError


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one, ``spark.checkpoint.dir``; in a local one if that is unset and all run in one process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root and spark.sparkContext.master.partition("[")[0] != "local":
        raise ConfigError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}" if root else "file://" + tempfile.mkdtemp(prefix=f"quern-{name}-")
