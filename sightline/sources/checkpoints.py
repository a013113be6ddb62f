"""The folder for checkpoints that iterative operators cut their lineage in."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def use_checkpoints(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, as in tests, a temporary folder."""
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="sightline-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current
