"""Lines that several documents share are kept in one of them only. DataFrame functions throughout.

Normalised lines are exploded as two 64-bit hashes (no line text is shuffled), documents are counted per hash by the smallest and the
largest id, and the positions to drop go back to their document, whose lines are then cut out in one pass. A line that a third of all
documents hold is one pre-aggregated row per task in the count; in the join it is the skewed side that adaptive execution splits.

Defined results: a null or empty text is one empty line. Rows of one ``doc_id`` count as one document, and their lines stay in all of
them if it is the smallest. Rows without an id pass through unchanged and are not counted. An empty table stays empty; other columns
are kept. A text in which every line goes is kept as an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import WHITE, ascii_lower
from logsift.scratch import saved


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(WHITE)))


def dedup_lines(docs: DataFrame, min_length: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped`` and ``kept`` (its text without the dropped lines), in place of columns of these names.

    A key of at least ``min_length`` characters in ``min_docs`` documents or more keeps its lines only in the smallest ``doc_id``.
    """
    # The row travels as one struct, so that none of its columns can clash with those made here.
    rows = docs.select(F.struct("*").alias("doc")).select("doc", F.col("doc.doc_id").alias("id"), F.xxhash64("doc.text").alias("version"))
    lines = F.split(F.coalesce("doc.text", F.lit("")), "\n", -1)
    keys = F.transform(lines, lambda line, at: F.struct(at.alias("at"), line_key(line).alias("key")))
    held = (
        rows.where(F.col("id").isNotNull())
        .select("id", "version", F.explode(keys).alias("line"))
        .where(F.char_length("line.key") >= min_length)
        .select("id", "version", "line.at", F.xxhash64("line.key").alias("h1"), F.xxhash64(F.lit(1), "line.key").alias("h2"))
    )
    if min_docs == 2:
        shared = held.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    else:
        once = held.select("h1", "h2", "id").distinct()
        shared = once.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    # A table of its own, so that the join below has an exchange on either side and its hot lines can be split.
    shared = saved(shared.select("h1", "h2", "first"), "shared-lines")
    dropped = (
        held.join(shared, ["h1", "h2"])
        .where(F.col("id") > F.col("first"))
        .groupBy("id", "version")
        .agg(F.array_sort(F.collect_set("at")).alias("drop"))
    )
    marked = rows.join(dropped, ["id", "version"], "left").select("doc", "drop", lines.alias("lines"))
    # The lines between one dropped position and the next, put together: linear in the document, however many go.
    edges = F.concat(F.array(F.lit(-1)), "drop", F.array(F.size("lines")))
    between = F.arrays_zip(F.slice(edges, 1, F.size("drop") + 1).alias("a"), F.slice(edges, 2, F.size("drop") + 1).alias("b"))
    rest = F.flatten(F.transform(between, lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1)))
    kept = F.when(F.col("drop").isNull(), F.coalesce("doc.text", F.lit(""))).otherwise(F.array_join(rest, "\n"))
    made = {"n_lines": F.size("lines").cast("long"), "n_dropped": F.coalesce(F.size("drop"), F.lit(0)).cast("long"), "kept": kept}
    others = [F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in made]
    return marked.select("doc", *(c.alias(name) for name, c in made.items())).select(*others, *made)
