"""Folders as the JVM's file systems know them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    """(file system, path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    system, target = _system(spark, path)
    return system.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Entries of a folder; none if it does not exist."""
    system, target = _system(spark, folder)
    return [entry.getPath().getName() for entry in system.listStatus(target)] if system.exists(target) else []


def make(spark: SparkSession, folder: str) -> None:
    system, target = _system(spark, folder)
    system.mkdirs(target)


def remove(spark: SparkSession, path: str) -> None:
    system, target = _system(spark, path)
    system.delete(target, True)


def keep_only(spark: SparkSession, folder: str, name: str) -> None:
    """Delete all entries of ``folder`` but ``name``."""
    for entry in names(spark, folder):
        if entry != name:
            remove(spark, f"{folder}/{entry}")
