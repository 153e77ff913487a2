"""Outputs as a table of lines, for reports that group over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import hit_file, join_lines, split_lines


def to_lines(outputs: DataFrame, text: str = "raw") -> DataFrame:
    """One row per line, numbered from 0; an empty last line counts."""
    others = [c for c in outputs.columns if c != text]
    return outputs.select(*others, F.posexplode(F.expr(split_lines(text))).alias("n", "line"))


def in_blocks(lines: DataFrame, size: int = 65_536) -> DataFrame:
    """Add ``block``: stretches of lines, in which ordered work on one output is cut up."""
    return lines.withColumn("block", F.floor(F.col("n") / size))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``id, block, n, line`` of text files of any size; one file is read in many tasks.

    ``n`` orders the lines of a block and ``block`` the parts of a file. For outputs that do not fit a row.
    """
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("id"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("line"),
    )


def rejoined(text: str) -> str:
    """The text after a trip through its lines: unchanged."""
    return join_lines(split_lines(text))


def hits_per_file(lines: DataFrame) -> DataFrame:
    """Search hits per output and file. Partial counts leave the tasks, so one busy file is no skew."""
    hits = lines.withColumn("file", F.expr(hit_file("line"))).filter("file IS NOT NULL")
    return hits.groupBy("id", "file").agg(F.count(F.lit(1)).alias("hits"))
