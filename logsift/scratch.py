"""Where intermediate tables go: the cluster's shared folder, a temporary one only in local mode."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Unset, a local session gets a temporary one; a cluster has to name a shared one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="logsift-")
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write a table once and read it back: cuts the lineage and survives lost executors. ``codec`` is for tables that are large."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a table written here that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
