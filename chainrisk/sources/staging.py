"""Staged tables: cut a plan by writing it once to shared storage.

Loops and results with several readers are written as Parquet below the
folder named by ``spark.checkpoint.dir``.  A written table survives the loss
of executors, is computed once, and gives the planner its real size.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_PRIVATE: dict[str, tempfile.TemporaryDirectory] = {}
_WRITTEN: dict[str, list[str]] = {}


def staging_root(spark: SparkSession) -> str:
    """Shared folder for staged tables, as configured for the session.

    Only a local session without the setting (a test) gets a private folder,
    which goes away with the process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _PRIVATE:
        _PRIVATE[app] = tempfile.TemporaryDirectory(prefix="chainrisk-stage-")
    return _PRIVATE[app].name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    """Hadoop path and file system of a path, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; each must be a plain scan of one."""
    for df in tables:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            where, system = _file_system(df.sparkSession, folder)
            system.delete(where, True)


def staged(spark: SparkSession) -> list[str]:
    """Paths of the tables that this session has staged and not released as a whole."""
    return list(_WRITTEN.get(spark.sparkContext.applicationId, []))


def release_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables by path, once the results that read them are written."""
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where, system = _file_system(spark, path)
        system.delete(where, True)
        if path in known:
            known.remove(path)


def discard(spark: SparkSession) -> None:
    """Delete all tables that this session has staged; frames that read them end with them."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        where, system = _file_system(spark, path)
        system.delete(where, True)


def table_versions(spark: SparkSession, folder: str) -> tuple:
    """Name, size and time of every table file of a folder: another value once one is rewritten."""
    where, system = _file_system(spark, folder)
    found = []
    for entry in system.listStatus(where):
        inside = system.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
        found += [(str(f.getPath()), f.getLen(), f.getModificationTime()) for f in inside]
    return tuple(sorted(found))
