"""Intermediate tables and files of queries: the folder that all executors see."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Spark's checkpoint folder; a temporary one only where none is set and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("on a cluster, name a shared folder in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="metrolex-")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A path below the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: it is worked out once, cuts the lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reaches."""
    files, p = _path(spark, path)
    return files.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    files, p = _path(spark, path)
    files.mkdirs(p)


def remove(spark: SparkSession, path: str) -> None:
    files, p = _path(spark, path)
    files.delete(p, True)
