"""The folds on a table of lines ``id, block, n, line``, for outputs too large to be one row.

Here one output may hold most of the lines of a corpus, so nothing is partitioned by output alone:
neighbours are compared inside blocks and carried over block edges, "first few per key" leaves every task
as a few rows per key, and counts are added up before the shuffle. Lines keep their ``block`` and ``n``;
none of ``id``, ``block`` and ``n`` may be NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.text import fingerprint, hit_file
from logsift.scratch import saved

COLUMNS = ["id", "block", "n", "line"]


def _marker(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _runs(lines: DataFrame) -> DataFrame:
    """Add ``at`` and ``length``: where in its run of equal fingerprints a line stands, and how long the run is.

    Fingerprints are only compared here, so they are shuffled as 16 bytes each, NULL for an empty one.
    Runs are found inside blocks. One row per block says how its first and last run look; a window over
    those tells each block how many lines of its first run lie before it and of its last run after it.
    """
    inside = W.partitionBy("id", "block").orderBy("n")
    printed = lines.select(*COLUMNS, F.unhex(F.md5(F.nullif(F.expr(fingerprint("line")), F.lit("")))).alias("fp"))
    starts = ~F.coalesce(F.col("fp") == F.lag("fp").over(inside), F.lit(False))
    local = printed.withColumn("_start", starts.cast("int"))
    local = local.withColumn("_run", F.sum("_start").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    run = W.partitionBy("id", "block", "_run")
    local = local.select(
        "*", F.row_number().over(run.orderBy("n")).alias("_nth"), F.count(F.lit(1)).over(run).alias("_len"),
        (F.max("_run").over(W.partitionBy("id", "block")) == F.col("_run")).alias("_is_last"),
    )

    edges = local.groupBy("id", "block").agg(
        F.count(F.lit(1)).alias("_rows"), (F.max("_run") == 1).alias("_single"),
        F.min_by(F.struct("fp", "_len"), "n").alias("_head"), F.max_by(F.struct("fp", "_len"), "n").alias("_tail"),
    )
    order = W.partitionBy("id").orderBy("block")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    ahead = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    joined_on = F.col("_head.fp") == F.lag("_tail.fp").over(order)
    edges = edges.select("*", ahead.alias("_ahead"), F.coalesce(joined_on, F.lit(False)).alias("_on"), F.sum("_rows").over(W.partitionBy("id")).alias("_all"))
    # Ranks of the last and the first line in the block that begin a run; none in the middle of a long run.
    last_start = F.when(~(F.col("_single") & F.col("_on")), F.col("_ahead") + F.col("_rows") - F.col("_tail._len") + 1)
    first_start = F.when(~F.col("_on"), F.col("_ahead") + 1).when(~F.col("_single"), F.col("_ahead") + F.col("_head._len") + 1)
    edges = edges.select(
        "id", "block",
        F.when(F.col("_on"), F.col("_ahead") - F.max(last_start).over(before) + 1).otherwise(0).alias("_in"),
        F.when(
            F.coalesce(F.lead("_on").over(order), F.lit(False)),
            F.coalesce(F.min(first_start).over(after), F.col("_all") + 1) - F.col("_ahead") - F.col("_rows") - 1,
        ).otherwise(0).alias("_out"),
    )
    rows = local.join(edges, ["id", "block"])
    inn = F.when(F.col("_run") == 1, F.col("_in")).otherwise(0)
    out = F.when(F.col("_is_last"), F.col("_out")).otherwise(0)
    return rows.select(*COLUMNS, (F.col("_nth") - 1 + inn).alias("at"), (F.col("_len") + inn + out).alias("length"))


def collapse_repeats(lines: DataFrame, threshold: int = 3, made: bool = False) -> DataFrame:
    """Neighbouring lines with one non-empty fingerprint: the first stays, a marker counts the run.

    With ``made``, here and in the folds below, a column of this name says which lines are markers.
    """
    runs = _runs(lines)
    folded = F.col("length") >= threshold
    marked = folded & (F.col("at") == 1)
    text = F.when(marked, _marker("    … ⟨×", F.col("length"), " similar lines⟩")).otherwise(F.col("line"))
    return runs.filter(~folded | (F.col("at") <= 1)).select("id", "block", "n", text.alias("line"), *[marked.alias("made")] * made)


def squeeze_blanks(lines: DataFrame, blank: Column) -> DataFrame:
    """Add ``again``: is the line blank and the one before it, too? A block learns that of its first line from the block before."""
    inside, order = W.partitionBy("id", "block").orderBy("n"), W.partitionBy("id").orderBy("block")
    marked = lines.select(*COLUMNS, blank.alias("blank"))
    edges = marked.groupBy("id", "block").agg(F.max_by("blank", "n").alias("last"))
    edges = edges.select("id", "block", F.coalesce(F.lag("last").over(order), F.lit(False)).alias("carried"))
    before = F.lag("blank").over(inside).alias("before")
    return marked.select("*", before).join(edges, ["id", "block"]).select(*COLUMNS, (F.col("blank") & F.coalesce("before", "carried")).alias("again"))


def count_dropped(lines: DataFrame, noise: Column, what: str) -> DataFrame:
    """Lines that are not noise, and after an output's last line a marker with the number of those that went."""
    judged = lines.select(*COLUMNS, F.coalesce(noise, F.lit(False)).alias("noise"))
    sums = judged.groupBy("id").agg(F.count_if("noise").alias("hidden"), F.max(F.struct("block", "n")).alias("last")).where("hidden > 0")
    marker = _marker("… ⟨", F.col("hidden"), f" {what} hidden⟩").alias("line")
    marked = sums.select("id", F.col("last.block").alias("block"), (F.col("last.n") + 1).alias("n"), marker, F.lit(True).alias("made"))
    return judged.where("not noise").select(*COLUMNS, F.lit(False).alias("made")).union(marked)


def _cap(lines: DataFrame, key: Column, keep: int, marker, made: bool) -> DataFrame:
    """First ``keep`` lines per output and key, then a marker. Lines without a key stay."""
    # Written once: the lines and their keys are made for the counts, the first lines and the lines without a key alike.
    written = saved(lines.select(*COLUMNS, key.alias("key")), "keyed-lines", "zstd")
    keyed = written.filter(F.col("key").isNotNull())
    first = keyed.withColumn("rank", F.row_number().over(W.partitionBy("id", "key").orderBy("block", "n"))).filter(F.col("rank") <= keep + 1)
    counts = keyed.groupBy("id", "key").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > keep)
    # Both sides lie by id and key already. Only the row after the kept ones asks for the count.
    over = F.col("rank") > keep
    counted = first.join(counts, ["id", "key"], "left").filter(~over | F.col("count").isNotNull())
    line = F.when(over, marker(F.col("key"), F.col("count") - keep)).otherwise(F.col("line"))
    capped = counted.select("id", "block", "n", line.alias("line"), *[over.alias("made")] * made)
    free = written.filter(F.col("key").isNull() & F.lit(keep > 0))
    return free.select(*COLUMNS, *[F.lit(False).alias("made")] * made).unionByName(capped)


def cascade_guard(lines: DataFrame, most: int = 5, made: bool = False) -> DataFrame:
    """A fingerprint seen more than ``most`` times anywhere in an output keeps its first ``most``."""
    fp = F.nullif(F.expr(fingerprint("line")), F.lit(""))
    return _cap(lines, fp, most, lambda _, more: _marker("    … ⟨and ", more, " more like this⟩"), made)


def limit_per_file(lines: DataFrame, keep: int = 5, made: bool = False) -> DataFrame:
    """At most ``keep`` search hits per file; lines that are not hits always stay."""
    return _cap(lines, F.expr(hit_file("line")), keep, lambda file, more: _marker("    … ⟨+", more, " more in ", file, "⟩"), made)


def keep_ends(lines: DataFrame, head: int, tail: int, label: str = "lines", made: bool = False) -> DataFrame:
    """First ``head`` and last ``tail`` lines around a marker, when that is shorter."""
    head, tail = max(0, int(head)), max(0, int(tail))
    lines = lines.select(*COLUMNS)
    up, down = W.partitionBy("id").orderBy("block", "n"), W.partitionBy("id").orderBy(F.desc("block"), F.desc("n"))
    counts = lines.groupBy("id").agg(F.count(F.lit(1)).alias("count"))
    # At most head + tail + 1 rows per output reach each join.
    start = lines.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= head + tail + 1).join(counts, "id")
    end = lines.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= tail).join(counts, "id")
    short = F.col("count") <= head + tail + 1
    marker = _marker("… ⟨", F.col("count") - (head + tail), f" {label} hidden⟩")
    marked = ~short & (F.col("rank") == head + 1)
    text = F.when(marked, marker).otherwise(F.col("line"))
    first = start.filter(short | (F.col("rank") <= head + 1)).select("id", "block", "n", text.alias("line"), *[marked.alias("made")] * made)
    return first.unionByName(end.filter(~short).select(*COLUMNS, *[F.lit(False).alias("made")] * made))
