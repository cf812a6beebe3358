"""Intermediate tables that survive the loss of executors.

A table is written as Parquet below the folder that ``spark.checkpoint.dir`` names, which every
executor of a cluster can reach, and read back, so that its lineage ends there.  Only a local
session that names no folder, as in tests, gets a temporary one.  The application's tables go
when its driver ends.

Long plans of many small queries leave the driver little that lives and much garbage, for which
its heap would grow to its limit; so the driver collects it after every few tables.  Broadcasts
and shuffle files of plans that are done with go with it.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_ending: set[str] = set()


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def folder(spark: SparkSession) -> str:
    """A new name below the shared folder."""
    base = spark.conf.get(_KEY, None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"set {_KEY} to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        base = "file://" + made
        spark.conf.set(_KEY, base)
    of_application = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if of_application not in _ending:
        where, files = _path(spark, of_application)
        files.mkdirs(where)
        files.deleteOnExit(where)
        _ending.add(of_application)
    return f"{of_application}/{uuid.uuid4().hex}"


#: Files of a narrow table for each core of the cluster, at most; tables between collections.
_FILES, _TABLES = 3, 8
_written = count(1)


def written(df: DataFrame, path: str | None = None, narrow: bool = False) -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    A ``narrow`` table, of a few numbers a row, is written by a few tasks for each core rather
    than one for each partition of a shuffle, which would make many tiny files of it.
    """
    spark = df.sparkSession
    path = path or folder(spark)
    if narrow:
        df = df.coalesce(_FILES * spark.sparkContext.defaultParallelism)
    # Without the marker of success, for which a local file system starts a process in the driver.
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    if next(_written) % _TABLES == 0:
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made here."""
    where, files = _path(spark, path)
    files.delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under a path of any file system that Spark reaches."""
    where, files = _path(spark, path)
    return files.exists(where)
