"""Connected components by smallest label, in rounds that are each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.scratch import saved


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node, itself included) for every node in the links ``a, b``.

    A round gives each node the smallest label among its neighbours and then the label of its label, so labels travel twice as far with
    every round. The driver only learns whether anything changed. A hot key (the label of a large component) is met on one side of a join
    only, between tables that were written, so adaptive execution can split it. Repeated links, loops and both directions may occur; links with a null end are ignored.
    """
    given = links.select("a", "b").where("a is not null and b is not null and a <> b")
    edges = saved(given.union(given.select("b", "a")).distinct(), "edges")
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = saved(labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("next")), "lower")
        further = lower.select(F.col("node").alias("next"), F.col("next").alias("far"))
        moved = lower.join(further, "next").select("node", F.col("far").alias("label"), (F.col("far") < F.col("label")).alias("moved"))
        labels = saved(moved, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
        labels = labels.select("node", "label")
