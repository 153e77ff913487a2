"""Repeated reads on a stream of requests.

Every micro-batch runs the batch decision with the ledger the batch before left. That keeps the work of
a busy key spread over its time blocks, which per-key state in one task would not. Two folders take
turns for the ledger: a batch reads one and replaces the other, so it can be run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from logsift.operators.requests import expire, ledger_after, repeat_reads
from logsift.options import DEFAULTS, Options


def start_ledger(requests: DataFrame, path: str, checkpoint: str, opts: Options = DEFAULTS, trigger: dict | None = None):
    """Decisions go to ``path/decisions/batch=n``, the ledger to ``path/ledger-0`` and ``-1`` in turn."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/ledger-{(number - 1) % 2}") if number else None
        written = f"{path}/decisions/batch={number}"
        batch.persist()
        try:
            repeat_reads(batch, opts, old).write.mode("overwrite").parquet(written)
            now = ledger_after(spark.read.parquet(written), batch, opts, old)
            newest = batch.agg({"ts": "max"}).first()[0]
            if newest is not None:
                now = expire(now, newest, opts)
            now.write.mode("overwrite").parquet(f"{path}/ledger-{number % 2}")
        finally:
            batch.unpersist()

    writer = requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
