"""Folder for checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under the cluster's shared checkpoint folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only when nothing is
    named, as in local tests, a temporary folder takes its place.
    """
    context = spark.sparkContext
    base = spark.conf.get(_SETTING, None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="starmill-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
