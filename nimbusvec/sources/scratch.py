"""A folder that driver and executors share, for files between two steps of a query."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; unset, a temporary folder on a local master, which then also takes checkpoints."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="nimbusvec-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        at = f"file://{at}"
        spark.conf.set("spark.checkpoint.dir", at)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """As new(), made, for writers that don't make folders."""
    path = new(spark, label)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return path
