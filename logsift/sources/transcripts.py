"""Agent transcripts (JSON lines) as rows ``path, block, pos, line``.

``pos`` orders the lines of one ``(path, block)`` and ``block`` the stretches of a file; Spark may read
one large file in many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.ordered import checked_join
from logsift.scratch import saved


def read_transcripts(spark: SparkSession, roots: list[str], days: int | None = None) -> DataFrame:
    """All lines of all ``*.jsonl`` files under the roots; ``days`` prunes files by modification time.

    Lines end with a line feed only, so that their bytes add up to the file's; a carriage return before it stays, which JSON allows. A
    damaged file gives the lines before the damage; :func:`logsift.plans.audit.file_states` finds it by its size.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("ignoreCorruptFiles", True).option("lineSep", "\n").text(roots)
    if days:
        cut = F.current_timestamp() - F.make_dt_interval(F.lit(days))
        files = files.filter(F.col("_metadata.file_modification_time") >= cut)
    return files.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def list_transcripts(spark: SparkSession, roots: list[str], days: int | None = None) -> DataFrame:
    """Path and size of the transcript files; no content is read. Spark does not list empty files."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").load(roots)
    )
    if days:
        files = files.filter(F.col("modificationTime") >= F.current_timestamp() - F.make_dt_interval(F.lit(days)))
    return files.select("path", F.col("length").alias("size"))


def _parent(path) -> F.Column:
    return F.regexp_replace(path, "[^/]*$", "")


def drop_twins(lines: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Leave out ``transcript.jsonl`` where ``transcript_full.jsonl`` lies next to it.

    ``paths`` is the list of files (:func:`list_transcripts` gives it without reading them); by default it
    is taken from the lines. The choice is made per file and written, then brought back to the lines.
    """
    name = F.substring_index("path", "/", -1)
    kept = lambda wanted: F.max(F.when(name == wanted, F.col("path")))
    pairs = (lines if paths is None else paths).filter(name.isin("transcript.jsonl", "transcript_full.jsonl"))
    pairs = pairs.groupBy(_parent(F.col("path")).alias("parent")).agg(
        kept("transcript.jsonl").alias("path"), kept("transcript_full.jsonl").alias("full")
    )
    twins = pairs.filter("path IS NOT NULL AND full IS NOT NULL").select("path", F.lit(True).alias("_twin"))
    twins = saved(twins, "twins")
    return checked_join(lines, twins, ["path"], F.col("pos")).filter(F.col("_twin").isNull()).drop("_twin")
