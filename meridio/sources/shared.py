"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process, a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("meridio.shared.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: executors of {master} share no other folder")
        base = "file://" + tempfile.mkdtemp(prefix="meridio-shared-")
        spark.conf.set("meridio.shared.dir", base)
    return base.rstrip("/")


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the shared folder, emptied at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/meridio-{uuid.uuid4().hex}"
    fs, p = file_system(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return f"{path}/{name}"


def replace(spark: SparkSession, written: str, target: str) -> None:
    """What was written takes the place of the target; a reader that fails in between reads again."""
    fs, new = file_system(spark, written)
    _, old = file_system(spark, target)
    fs.delete(old, True)
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        raise OSError(f"{written} could not be moved to {target}")
