"""Claims and deletions in the shared storage that tables are written to."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def claim(spark: SparkSession, path: str) -> bool:
    """Create an empty marker file; False if somebody else has.

    Distributed file systems create without overwriting in one step; Hadoop's
    local one looks first and then creates, so there Java's own way is taken.
    """
    fs, marker = _path(spark, path)
    if fs.getUri().getScheme() != "file":
        return bool(fs.createNewFile(marker))
    fs.mkdirs(marker.getParent())
    return bool(spark.sparkContext._jvm.java.io.File(marker.toUri().getPath()).createNewFile())


def exists(spark: SparkSession, path: str) -> bool:
    fs, found = _path(spark, path)
    return bool(fs.exists(found))


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all that is in it; False if there is none."""
    fs, found = _path(spark, path)
    return bool(fs.delete(found, True))


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    fs, found = _path(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(found)] if fs.exists(found) else []


def folder_of(spark: SparkSession, column: str, value: str) -> str:
    """The folder of a partition value, as Spark names it."""
    return f"{column}={spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}"
