"""Folder operations on whatever file system a path names (local, HDFS, object store),
through the Hadoop FileSystem that Spark itself uses."""

from __future__ import annotations

from pyspark.sql import SparkSession


#: writer options of a folder whose ``_SUCCESS`` marker is set later, by :func:`mark_complete`
UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as ``scheme:/...`` without an empty authority."""
    fs, p = _fs(spark, path)
    return str(fs.makeQualified(p).toString())


def is_dir(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p) and fs.getFileStatus(p).isDirectory())


def is_complete(spark: SparkSession, path: str) -> bool:
    """A folder written by a finished Spark job carries a ``_SUCCESS`` marker."""
    return exists(spark, f"{path.rstrip('/')}/_SUCCESS")


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` (empty when it does not exist)."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def rename(spark: SparkSession, src: str, dst: str) -> bool:
    fs, p = _fs(spark, src)
    jvm = spark.sparkContext._jvm
    return bool(fs.rename(p, jvm.org.apache.hadoop.fs.Path(dst)))


def mark_complete(spark: SparkSession, path: str) -> None:
    """Set the marker that :func:`is_complete` looks for."""
    fs, p = _fs(spark, f"{path.rstrip('/')}/_SUCCESS")
    fs.create(p, True).close()
