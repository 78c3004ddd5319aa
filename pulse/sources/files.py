"""Folders and files of stored tables, as the file system that Spark reads from lists them.

Names and sizes come from the driver's file system client, a folder at a time: no
job runs and no data file is opened.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# What a file status prints of itself; a folder's whole listing is fetched as one text.
_STATUS = re.compile(r"path=(.*?); isDirectory=(true|false);(?: length=(\d+);)?.*?modification_time=(\d+);")


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a file or a folder with all it holds; False if there was none."""
    fs, where = _open(spark, path)
    return fs.delete(where, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, where = _open(spark, path)
    if not fs.rename(where, spark._jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"cannot move {path} to {to}")


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = _open(spark, path)
    fs.mkdirs(where)


def listing(spark: SparkSession, path: str) -> list[tuple[str, bool, int, int]]:
    """(path, is a folder, bytes, modification time) of a file, or of what is in a folder; nothing if it is not there."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return []
    text = spark._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(where))
    return sorted((p, d == "true", int(n or 0), int(t)) for p, d, n, t in _STATUS.findall(text))


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, without hidden ones."""
    names = (p.rstrip("/").rsplit("/", 1)[-1] for p, *_ in listing(spark, folder))
    return [n for n in names if n[0] not in "._"]


def values(spark: SparkSession, folder: str, column: str) -> list[str]:
    """The values of a partition column whose folders lie in ``folder``."""
    return [n[len(column) + 1:] for n in children(spark, folder) if n.startswith(f"{column}=")]


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, modification time) of all data files at or below ``path``."""
    out, folders = [], [path]
    while folders:
        for p, is_folder, size, at in listing(spark, folders.pop()):
            if p.rstrip("/").rsplit("/", 1)[-1][0] not in "._":
                folders.append(p) if is_folder else out.append((p, size, at))
    return sorted(out)


def read_partitions(spark: SparkSession, table: str, folders: list[str], schema) -> DataFrame:
    """The rows below some partition folders of ``table``; only these are listed and read."""
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", table).parquet(*folders)
