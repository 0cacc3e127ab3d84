"""Derived tables kept beside a cache root, valid as long as their source and version are the same."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.runtime import exists


def state_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, time of change) of a file, or of the files of a folder, on any file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed)


def cached(spark: SparkSession, source: str, root: str, version: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` makes of a source: read if it was made from this state of the source by this version, else made and kept.

    A table that was broken off has no mark of success and is made again.
    """
    key = hashlib.sha256(json.dumps([source, version, state_of(spark, source)]).encode()).hexdigest()[:32]
    path = f"{root.rstrip('/')}/{key}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
