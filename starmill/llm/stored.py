"""Intermediate tables written to the cluster's shared folder, which cut the lineage.

A written table survives the loss of executors; a read of it never repeats the work that
made it. The folder is the one that ``spark.checkpoint.dir`` names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from starmill.functions.shared import shared_dir


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder."""
    return stored_at(df, purpose)[0]


def stored_at(df: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no later read needs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
