"""A folder for what a session writes along the way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []
_MADE: list[str] = []


def scratch_base(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir. Where that is unset and Spark
    runs on this machine alone, a temporary folder that goes with the process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lattis-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return "file://" + _LOCAL[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, known to drop_scratch()."""
    _MADE.append(f"{scratch_base(spark)}/lattis-{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def drop_scratch(spark: SparkSession) -> None:
    """Delete what was written to all paths given out so far; frames that read it can't be used any more."""
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
