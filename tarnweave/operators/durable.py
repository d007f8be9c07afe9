"""Intermediate results that outlive executors."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one; on a cluster that raises, as executors would not see each other's files."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tarnweave-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder: plans stay short, partitions stay as they are, lost executors cost nothing that was done before."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
