"""Intermediate tables: one folder per application below ``spark.checkpoint.dir``.

A table that several passes read is written there once and read again, so a lost executor costs
the rest of a stage only. ``release`` gives the folder back; a table of it must not be read after.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabletidy.session import checkpoint_dir


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tabletidy/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in it."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
