"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back.

    Cuts lineage: what follows reads finished files that every executor can
    see, so a lost executor costs only its running tasks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions_for(rows: int, rows_per_partition: int) -> int:
    """Number of partitions so that none holds much more than ``rows_per_partition`` rows."""
    return max(1, -(-rows // rows_per_partition))


def utf8(col: Column) -> Column:
    """UTF-8 bytes of a text column; null is the empty text."""
    return F.encode(F.coalesce(col, F.lit("")), "UTF-8")


def with_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is shipped with the job (``--py-files``) and this path is merely absent.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])
    return spark
