"""Counters kept up to date by Structured Streaming.

The state is one row per runtime or label, so the whole report is rewritten after every batch. Batches take
turns in three folders and note their number: a batch that is run again replaces what it wrote, the newest
report stays while the next is written, and the files do not grow in number however long the stream runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.plans.reports import by_label, client_parts, efficiency, label_parts, lifetime, savings_parts


TURNS = 3


def _start(parts: DataFrame, path: str, checkpoint: str, trigger: dict | None):
    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).coalesce(1).write.mode("overwrite").parquet(f"{path}/turn={number % TURNS}")

    writer = parts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(save)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """Counters after the newest batch."""
    parts = spark.read.parquet(path)
    newest = parts.agg(F.max("batch").alias("batch"))
    return parts.join(F.broadcast(newest), "batch").drop("batch", "turn")


def start_clients(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    return _start(client_parts(events), path, checkpoint, trigger)


def start_lifetime(results: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    return _start(savings_parts(results), path, checkpoint, trigger)


def start_labels(results: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    return _start(label_parts(results), path, checkpoint, trigger)


def clients(spark: SparkSession, path: str) -> DataFrame:
    return efficiency(latest(spark, path))


def lifetime_totals(spark: SparkSession, path: str) -> DataFrame:
    return lifetime(latest(spark, path))


def labels(spark: SparkSession, path: str) -> DataFrame:
    return by_label(latest(spark, path))
