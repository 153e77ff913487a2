"""Streaming twins of batch queries, run over all available files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import metric_columns, request_columns, tokens_sql
from checks.registry import ORACLES, check
from checks.rules import EFFICIENCY, LIFETIME
from logsift.scratch import new_path
from logsift.streaming import counters
from logsift.streaming.compress import start_compress
from logsift.streaming.ledger import start_ledger

FILE_ROWS = 100_000


def _stream(spark, sf, name):
    """The table as a stream of its files, on all cores if they are few (as ``spread`` does for tables)."""
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    # A pattern that only this table's name fits: a table may be one file, which a stream reads by a pattern only, or a folder of files.
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/{name}[.]parquet")
    cores = spark.sparkContext.defaultParallelism
    return stream if table.rdd.getNumPartitions() >= cores else stream.repartition(cores, table.columns[0])


def _run(spark, start, *args, **options) -> str:
    path = new_path(spark, "stream")
    query = start(*args, f"{path}/out", f"{path}/checkpoint", **options)
    query.awaitTermination()
    return f"{path}/out"


@check("stream_counters", "WITH " + EFFICIENCY)
def q_counters(spark, sf):
    return counters.clients(spark, _run(spark, counters.start_clients, metric_columns(_stream(spark, sf, "events"))))


_DOCS = f"""r AS (SELECT doc_id AS id, {tokens_sql('text')} AS raw_tokens, text, CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END AS label, doc_id % 3 = 0 AS passthrough FROM documents)"""


def _results(docs):
    from logsift.functions.text import tokens

    before = F.expr(tokens("text"))
    return docs.select(
        before.alias("raw_tokens"), F.floor(before / 3).alias("comp_tokens"),
        F.expr("CASE WHEN doc_id % 4 = 0 THEN 'a' ELSE 'b' END").alias("label"), F.expr("doc_id % 3 = 0").alias("passthrough"),
        F.expr("timestamp_seconds(1704067200 + doc_id * 317)").alias("ts"),
    )


@check("stream_lifetime", f"""WITH {_DOCS}, done AS (SELECT *, CASE WHEN passthrough THEN raw_tokens ELSE raw_tokens // 3 END AS comp_tokens, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(id * 317) AS ts FROM r), """ + LIFETIME.format("done"))
def q_lifetime(spark, sf):
    path = _run(spark, counters.start_lifetime, _results(_stream(spark, sf, "documents")))
    return counters.lifetime_totals(spark, path)


@check("stream_labels", f"WITH {_DOCS} SELECT label, count(*) AS outputs, sum(raw_tokens - raw_tokens // 3) AS tokens_saved, round_even(sum(raw_tokens - raw_tokens // 3) * 100 / sum(raw_tokens), 1) AS reduction_pct FROM r WHERE NOT passthrough GROUP BY label")
def q_labels(spark, sf):
    return counters.labels(spark, _run(spark, counters.start_labels, _results(_stream(spark, sf, "documents"))))


@check("stream_repeat_reads", ORACLES["repeat_reads"])
def q_repeat_reads(spark, sf):
    path = _run(spark, start_ledger, request_columns(_stream(spark, sf, "events")))
    return spark.read.parquet(f"{path}/decisions").select("seq", "key", "epoch", "decision", "served_at")


@check("stream_ledger", ORACLES["read_ledger"] + " WHERE epoch_us(served_at) >= (SELECT max(epoch_us(ts)) FROM reqs) - 28800000000")
def q_ledger(spark, sf):
    path = _run(spark, start_ledger, request_columns(_stream(spark, sf, "events")))
    return spark.read.parquet(f"{path}/ledger-0").select("session", "key", "stamp", "served_at", "suppressed")


@check("stream_ledger_batches", f"SELECT seq, key, decision, served_at FROM ({ORACLES['repeat_reads']}) AS q")
def q_ledger_batches(spark, sf):
    """The same decisions from six micro-batches, with a restart after the first three. Epochs count from the start of a batch."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    path, parts = new_path(spark, "ledger-batches"), 6
    cuts = events.select(F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).approxQuantile("t", [k / parts for k in range(1, parts)], 0.01)
    part = sum(((F.unix_micros(F.col("ts").cast("timestamp")) >= int(c)).cast("int") for c in cuts), F.lit(0))
    # A part is as many files as its size asks for, so no task reads a whole one, and a batch is the files of one part.
    files = events.count() // (parts * FILE_ROWS) + 1
    for k in range(parts):
        events.filter(part == k).repartition(files).write.mode("append").parquet(f"{path}/in")
        while len(spark.read.schema(events.schema).parquet(f"{path}/in").inputFiles()) < (k + 1) * files:  # a small part fills fewer
            events.limit(0).coalesce(1).write.mode("append").parquet(f"{path}/in")
        if k in (parts // 2 - 1, parts - 1):
            stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in")
            start_ledger(request_columns(stream), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out/decisions").select("seq", "key", "decision", "served_at")


@check("stream_compress", ORACLES["compress_mixed"])
def q_compress(spark, sf):
    from checks.inputs import mixed

    path = _run(spark, start_compress, mixed(_stream(spark, sf, "documents")))
    done = spark.read.parquet(path)
    return done.select("id", "label", "raw_tokens", "comp_tokens", "saved", "passthrough", F.md5("body").alias("body"))
