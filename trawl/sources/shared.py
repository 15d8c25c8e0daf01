"""Folders that the driver and all executors share, for tables that jobs write for themselves."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str = "work") -> str:
    """A fresh path below ``spark.checkpoint.dir``; local masters may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}" if base else "file://" + tempfile.mkdtemp(prefix="trawl-") + f"/{name}"


def stored(df: DataFrame, name: str = "work") -> DataFrame:
    """``df`` written to such a folder and read back, so it is computed once."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
