"""Time the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) names the tables, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "compress_outputs", "savings_by_label", "savings_lifetime", "fingerprint_counts", "collapse_repeats", "cascade_guard", "limit_per_file",
    "clip_lines", "line_collapse", "json_views", "json_shape", "recall_rows", "byte_cap", "search_terms", "runtime_efficiency", "repeat_reads", "read_ledger",
    "selection_audit", "reference_packs", "session_floors", "runtime_floors", "tool_calls", "tool_result_size", "idle_surface", "stream_compress",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks.all import QUERIES
    from checks.inputs import outputs
    from checks.rules import results

    # Warm up the JVM and the Python workers before the first figure.
    for name in ("token_estimate", "compress_outputs"):
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)

    size = outputs(spark, SF).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("raw")).alias("bytes")).first()
    done = results(spark, SF).agg(F.sum("raw_tokens").alias("raw"), F.sum("comp_tokens").alias("comp")).first()
    spent = seconds["compress_outputs"]
    print(json.dumps({
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": SF.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "outputs_per_second": round(size.n / spent, 1),
        "ms_per_output": round(spent * 1000 / size.n, 3),
        "mb_per_second": round(size.bytes / spent / 1e6, 2),
        "tokens_in": done.raw,
        "tokens_out": done.comp,
        "reduction_pct": round((done.raw - done.comp) * 100 / done.raw, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
