"""Folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; in a single process without one, in a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return f"{named.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def remove(path: str, spark: SparkSession) -> None:
    """Delete a folder of :func:`shared_folder` that no later plan reads. Where the store can't be reached from here it stays."""
    import shutil

    local = path.removeprefix("file://") if path.startswith(("file:///", "/")) else None
    if local and spark.sparkContext.master.startswith("local"):
        shutil.rmtree(local, ignore_errors=True)
        return
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
