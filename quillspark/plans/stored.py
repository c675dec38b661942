"""Stored structures (indexes) of a folder of tables: built once in a session, then opened."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
_BUILT: dict[tuple[str, str, str], object] = {}


def checkpointing(spark: SparkSession) -> str:
    """The folder that driver and executors share, which also cuts lineage; one is made only if none
    is set and the master is local, else its machines would not share it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver's file system closes."""
    path = f"{checkpointing(spark)}/quill-{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], T]) -> T:
    """What ``build`` makes at a path, once for each session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        _BUILT[key] = build(scratch(spark, name))
    return _BUILT[key]
