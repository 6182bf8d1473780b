"""Tables in the cluster's shared folder, for cutting lineage in loops and for what several steps read.

One registry for the whole library: a staged table goes by discard(), or with all others since a mark by release().
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of this machine if it runs all of Spark; on a cluster an error."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tarnwork-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{folder}")
        given = spark.sparkContext.getCheckpointDir()
    return given.rstrip("/")


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_open: dict[str, SparkSession] = {}


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df under the shared folder and return the table read back: a cut in the lineage that outlives executors.

    The write's shuffle files go when it is done; nothing reads them again. The table goes by discard() or release().
    """
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    _open[path] = spark
    return out


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as it takes it: for names and moves of whole files, never for rows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _delete(path: str) -> None:
    files, where = file_system(_open.pop(path), path)
    files.delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for df in tables:
        _delete(_paths.pop(df))


def opened() -> set[str]:
    """Staged tables that are there now, for release()."""
    return set(_open)


def release(before: set[str], *keep: DataFrame) -> None:
    """Delete the tables staged since then, once the caller has written what it made of them, but for those to keep."""
    kept = {_paths[df] for df in keep}
    for path in [p for p in _open if p not in before and p not in kept]:
        _delete(path)


def adopt(path: str, spark: SparkSession) -> str:
    """A folder that an operator writes itself, to go with release()."""
    _open[path] = spark
    return path
