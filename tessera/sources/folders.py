"""Folders that the driver and all executors share, and scratch folders in them.

Every file that one task writes and another reads lies in the folder that ``spark.checkpoint.dir`` names. Where it names none, a
temporary folder stands in on a single machine; on a cluster that is an error, since nobody else would see it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

from tessera.functions.types import EngineError

_OWN: list[str] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI: one without a scheme is of the cluster's default file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:/") and not out.startswith("file://") else out


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared folder; it is removed when the driver's Python ends."""
    if not _OWN:
        atexit.register(clean, spark)
    path = f"{shared_root(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    _OWN.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that no later plan reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Remove every scratch folder of this driver."""
    while _OWN:
        try:
            delete(spark, _OWN.pop())
        except Exception:  # the session may have gone, and with it the way to its file system
            return
