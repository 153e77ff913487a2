"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

``mixture`` makes a plan of one row per source; whatever follows from it for a document is an expression on that row. A source gets its
share of the words by weight; a share above ``max_epochs`` times the source's own words stops there, and the rest is dealt again by
weight until none is above. All documents of a source are repeated whole as often as its target holds it. What is left of the target
goes once more to documents in the order of a seeded hash: those below the plan's cut are taken whole, those at the cut (a slice of
2^-24 of the hashes) in the same fraction each, which ends at the target up to a rounding of less than a word per such document.

The cut is found in two levels of 4,096 slices of the hash, so the largest group is one slice of a source and nothing is sorted whole.

Defined results: a null or empty text has size 0 and is taken 0 times its words. Rows without a source are one source, the last in
order. Rows without an id share one hash. Repeated rows are separate documents that are treated alike. Empty tables give no row. Other
columns are kept; those named like a column of the result are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import shuffle_partitions
from logsift.operators.ordered import checked_join
from logsift.scratch import saved

WORD = r"[^\x20\x09-\x0D]+"
PLAN = ("source_size", "target", "whole", "cut", "part")


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def slice_of(doc_id: str, seed: int) -> Column:
    """Six hexadecimal digits of a seeded hash of an id."""
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary")), 1, 6)


def sized(docs: DataFrame, seed: int, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents with ``size`` in words, ``source`` and the ``slice`` of their hash."""
    return docs.withColumns({"size": word_count(text), "source": F.col(source).cast("string"), "slice": slice_of(doc_id, seed)})


def cyclic_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``weight`` for each row of a table of sources: the given ones in turn, by code point of ``source``, null last.

    Sources are numbered within ranges and by the sizes of the ranges before, so that their number is not bound by one task.
    """
    ranges = shuffle_partitions(sources.sparkSession)
    dealt = saved(sources.repartitionByRange(ranges, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "sources")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    before = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    place = (within - 1 + F.col("before")) % len(weights)
    numbered = dealt.join(F.broadcast(before), "range").withColumn("place", place)
    return numbered.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") + 1).cast("int"))).drop("place", "range", "before")


def water_filled(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``target`` for each row of ``source_size, weight`` (a written table): its weight's share of ``total``, at most ``max_epochs`` sizes.

    A round asks for two sums and clamps every source above its bound; the level by weight only rises, so it ends when none is added.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    level, clamped = 0.0, 0
    while True:
        above = cap < F.lit(level) * F.col("weight")
        sums = sources.agg(F.sum(F.when(above, cap)).alias("kept"), F.sum(F.when(~above, F.col("weight"))).alias("open"), F.count_if(above).alias("n")).first()
        if level and sums["n"] == clamped or not sums["open"]:
            return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if sums["open"] else cap)
        clamped, level = sums["n"], (total - (sums["kept"] or 0.0)) / sums["open"]
        if level <= 0:
            return sources.withColumn("target", F.lit(0.0))


def mixture(rows: DataFrame, weights: Sequence[float], share: float, max_epochs: float = 2.0) -> DataFrame:
    """The plan: ``source, source_size, weight, target, whole, cut, part`` for the written rows of ``source, size, slice``."""
    weighted = cyclic_weights(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    weighted = saved(weighted, "weights")
    total = weighted.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    filled = water_filled(weighted, total * share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")
    filled = saved(filled.withColumn("whole", whole).withColumn("rest", F.greatest(rest, F.lit(0).cast("long"))), "targets")

    def reached(sums: DataFrame, level: str, before: str) -> DataFrame:
        """The slice of every source in which the running sum passes its rest, and the sum before it."""
        w = Window.partitionBy("source").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = sums.withColumn("upto", F.sum("n").over(w) + F.col(before))
        least = F.min_by(F.struct(F.col(level).alias("at"), (F.col("upto") - F.col("n")).alias("before"), "n"), F.col(level))
        return running.where(F.col("upto") > F.col("rest")).groupBy("source", "rest").agg(least.alias("found"))

    def with_plan(sums: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
        p = plan.select(F.col("source").alias("plan_source"), *columns)
        return sums.join(p, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")

    coarse = rows.groupBy("source", F.substring("slice", 1, 3).alias("coarse")).agg(F.sum("size").alias("n"))
    first = reached(with_plan(coarse, filled, "rest").withColumn("none", F.lit(0)), "coarse", "none")
    first = saved(first.select("source", "rest", F.col("found.at").alias("coarse"), F.col("found.before").alias("before")), "cuts")
    fine = checked(rows.withColumn("in_slice", F.substring("slice", 1, 3)), first, ("rest", "coarse", "before"), "inner").where("in_slice = coarse")
    fine = fine.groupBy("source", "rest", "before", "slice").agg(F.sum("size").alias("n"))
    second = reached(fine, "slice", "before")
    cuts = second.select(F.col("source").alias("cut_source"), F.col("found.at").alias("cut"), ((F.col("rest") - F.col("found.before")).cast("double") / F.col("found.n")).alias("part"))
    planned = filled.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").drop("cut_source", "rest")
    # Without a slice that passes the rest, every document is below the cut.
    return saved(planned.withColumns({"cut": F.coalesce("cut", F.lit("g")), "part": F.coalesce("part", F.lit(0.0))}), "plan")


def checked(rows: DataFrame, plan: DataFrame, columns: Sequence[str], how: str = "left") -> DataFrame:
    """Rows with columns of their source's plan: broadcast after counting the sources, else salted, for one source may hold most rows."""
    key = {"no_source": F.col("source").isNull(), "source_key": F.coalesce("source", F.lit(""))}
    known = plan.select(*(c.alias(k) for k, c in key.items()), *columns)
    return checked_join(rows.drop(*columns).withColumns(key), known, list(key), F.xxhash64("slice"), how).drop(*key)


def repeated(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows of ``source, size, slice`` with the plan's columns, ``repetitions`` (whole ones), ``part_words`` and ``taken``."""
    held = checked(rows, plan, PLAN)
    once_more = F.col("slice") < F.col("cut")
    part = F.when(F.col("slice") == F.col("cut"), F.floor(F.col("size") * F.col("part"))).otherwise(F.lit(0)).cast("long")
    held = held.withColumns({"repetitions": F.col("whole") + once_more.cast("long"), "part_words": part})
    return held.withColumn("taken", F.col("repetitions") * F.col("size") + F.col("part_words"))


def mixed_texts(docs: DataFrame, plan: DataFrame, seed: int, text: str = "text") -> DataFrame:
    """The mixed corpus itself: a row for each repetition (from 1) with the whole text, and one with its first words for a fraction."""
    rows = repeated(sized(docs, seed, text=text), plan)
    copies = F.transform(F.sequence(F.lit(1).cast("long"), F.col("repetitions")), lambda k: F.struct(k.alias("repetition"), F.lit(False).alias("cut")))
    whole = F.when(F.col("repetitions") > 0, copies).otherwise(F.array().cast("array<struct<repetition:bigint,cut:boolean>>"))
    fraction = F.when(F.col("part_words") > 0, F.array(F.struct((F.col("repetitions") + 1).alias("repetition"), F.lit(True).alias("cut")))).otherwise(F.array().cast("array<struct<repetition:bigint,cut:boolean>>"))
    out = rows.withColumn("copy", F.explode(F.concat(whole, fraction)))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    some = F.array_join(F.slice(words, F.lit(1), F.col("part_words").cast("int")), " ")
    return out.withColumns({text: F.when(F.col("copy.cut"), some).otherwise(F.col(text)), "repetition": F.col("copy.repetition")}).select(*docs.columns, "repetition")
