"""Compress outputs as they arrive. The pipeline is narrow, so it runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logsift.plans.compression import compress


def start_compress(outputs: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, **options):
    results = compress(outputs, **options)
    writer = results.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
