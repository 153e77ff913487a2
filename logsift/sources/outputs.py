"""Captured outputs as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_outputs(spark: SparkSession, path: str, command: str = "") -> DataFrame:
    """One output per file, all under one command label; ``id`` is the file.

    For files that do not fit a row use ``operators.lines.read_lines`` and the folds on line tables.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(
        F.col("_metadata.file_path").alias("id"),
        F.col("_metadata.file_modification_time").alias("ts"),
        F.lit(command).alias("command"),
        F.lit("").alias("cwd"),
        F.lit(0).alias("exit_code"),
        F.col("value").alias("raw"),
    )


def spread(outputs: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table of a few files. A table with a split per core is returned as it is."""
    cores = outputs.sparkSession.sparkContext.defaultParallelism
    return outputs if outputs.rdd.getNumPartitions() >= cores else outputs.repartition(cores, key)
