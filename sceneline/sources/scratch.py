"""Where intermediate tables go: the folder that a cluster shares, or one of this process on a single machine."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    path = tempfile.mkdtemp(prefix="sceneline-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is not set, a folder of this process, but only if Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that no later step reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
