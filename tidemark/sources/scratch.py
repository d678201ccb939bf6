"""Scratch tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What holds while a scratch table is written: Spark deletes the query's shuffle files with its end, rather than when the driver
#: happens to collect garbage, and batches for Python are small, so that long texts don't fill the memory beside the heap.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_FOLDERS: dict[str, str] = {}
_TABLES: list[str] = []  # paths of saved tables, in order


def shared_dir(spark: SparkSession) -> str:
    """This session's folder below spark.checkpoint.dir, which all executors share.

    Where that is unset a local temporary folder serves, but only if the master is local: executors on other machines couldn't read it.
    """
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root and not re.match(r"local(\[|$)", spark.sparkContext.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _FOLDERS[app] = f"{(root or tempfile.mkdtemp(prefix='tidemark-')).rstrip('/')}/tidemark-{uuid.uuid4().hex}"
        atexit.register(remove, spark, _FOLDERS[app])
    return _FOLDERS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path, as it may be in any store."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder."""
    try:
        fs, where = filesystem(spark, path)
        fs.delete(where, True)
    except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: this cuts lineage and survives lost executors.

    The shuffle files of the write are deleted with its end, so that steps don't add up on the executors' disks.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    _TABLES.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that no plan reads any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch)


@contextmanager
def only_kept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables saved inside the block at its end, but for those put into the list that it gives."""
    first, kept = len(_TABLES), []
    yield kept
    for path in set(_TABLES[first:]).difference(t.scratch for t in kept):
        remove(spark, path)
