"""Folders in the file system that Spark itself uses (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def is_complete(spark: SparkSession, path: str) -> bool:
    """A folder whose write job committed (a killed one leaves no marker)."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def children(spark: SparkSession, path: str) -> list[str]:
    """Full paths of the entries of a folder; none if it is missing."""
    fs, p = _at(spark, path)
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []
