"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers of this machine import the package without an installation;
    on a cluster, install it or send it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    there = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in there:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, there)])
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where it is unset, a temporary folder of
    this machine for a session that runs in one JVM; on a cluster that would be another
    folder on every machine, so it is an error."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        there = f"file://{tempfile.gettempdir()}/folioforge-{os.getpid()}"
    return there.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, dropped when the session's JVM ends."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
