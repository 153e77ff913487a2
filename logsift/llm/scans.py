"""Positions and running sums within keys of any size: sorted ranges, and one carried value per range."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import shuffle_partitions
from logsift.scratch import saved

ROWS = 1_000_000


def range_sorted(rows: DataFrame, order: Sequence[Column], name: str, per_range: int = ROWS) -> DataFrame:
    """The rows written in ranges of their order, each with the number of its ``range``; ranges hold about ``per_range`` rows at most."""
    written = saved(rows, f"{name}-rows")
    ranges = max(shuffle_partitions(rows.sparkSession), -(-written.count() // per_range))
    return saved(written.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()), name)


def running(rows: DataFrame, key: Sequence[str], order: Sequence[Column], parts: dict[str, tuple[str, Callable[[Column], Column], Callable[[Column, Column], Column]]]) -> DataFrame:
    """Columns ``name: (column, aggregate, combine)`` aggregated from the first row of a key to each row, over a ``range_sorted`` table.

    Within a range this is a window; a key that goes on in a later range takes what the ranges before hold of it. Only the first key of
    a range can go on, so there is at most one such row per range, and these are broadcast.
    """
    local = Window.partitionBy("range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = rows.withColumns({name: aggregate(F.col(column)).over(local) for name, (column, aggregate, _) in parts.items()})
    sums = rows.groupBy(*key, "range").agg(*(aggregate(F.col(column)).alias(f"carried_{name}") for name, (column, aggregate, _) in parts.items()))
    ahead = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumns({f"carried_{name}": aggregate(F.col(f"carried_{name}")).over(ahead) for name, (_, aggregate, _) in parts.items()} | {"earlier": F.count(F.lit(1)).over(ahead)})
    carried = carried.where("earlier > 0").drop("earlier")
    whole = here.join(F.broadcast(carried), [*key, "range"], "left")
    combined = {name: F.when(F.col(f"carried_{name}").isNull(), F.col(name)).otherwise(combine(F.col(name), F.col(f"carried_{name}"))) for name, (_, _, combine) in parts.items()}
    return whole.withColumns(combined).drop(*(f"carried_{name}" for name in parts))


def added(column: str) -> tuple:
    return (column, F.sum, lambda a, b: a + b)


def xored(column: str) -> tuple:
    return (column, F.bit_xor, lambda a, b: a.bitwiseXOR(b))
