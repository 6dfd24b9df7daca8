"""Folders of the file system that a path belongs to, seen as Spark sees them."""

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below a path; none where it does not exist."""
    system, at = _place(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at) if s.isDirectory()) if system.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _place(spark, path)
    return system.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds; nothing happens where there is none."""
    system, at = _place(spark, path)
    system.delete(at, True)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a Spark job has finished writing a folder."""
    return exists(spark, f"{path}/_SUCCESS")
