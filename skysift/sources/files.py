"""Path helpers over any Hadoop-compatible file system."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is missing."""
    fs, target = _located(spark, path)
    return [entry.getPath().getName() for entry in fs.listStatus(target)] if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, target = _located(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Give a folder its final name, in one step where the file system can."""
    fs, old = _located(spark, source)
    if not fs.rename(old, spark._jvm.org.apache.hadoop.fs.Path(target)):
        raise OSError(f"cannot move {source} to {target}")


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty file; false if it exists already. Of several callers one succeeds."""
    fs, target = _located(spark, path)
    try:
        fs.create(target, False).close()
    except Exception:
        if fs.exists(target):
            return False
        raise
    return True


def size(spark: SparkSession, path: str) -> int:
    """Bytes below a path; 0 if it is missing."""
    fs, target = _located(spark, path)
    return fs.getContentSummary(target).getLength() if fs.exists(target) else 0
