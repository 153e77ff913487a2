"""Small helpers of the operators in this folder."""

from __future__ import annotations

import pickle
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.scratch import saved

# What the contracts count as white space around and between words.
WHITE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(doc_id: str, parts: int) -> Column:
    """Remainder of the CRC-32 of an id written as text; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % parts, F.lit(-1))


def shared_value(spark: SparkSession, value: Any) -> Any:
    """A broadcast value together with its class, as workers may run without this package on their path."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def opened(shared: Any) -> Any:
    return pickle.loads(shared.value)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[DataFrame, dict[int, int]]:
    """Texts of at most ``most`` ids of each label (0 or 1), and how many labelled rows there are of either.

    Which ids are learned from is settled on ids and labels alone, by a hash of the id, so the texts are read once and none is shuffled:
    the chosen ids, at most 2 x ``most``, are broadcast. Rows without an id or a label are left out; a repeated label counts once.
    """
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).distinct()
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("rows"))
    known = saved(given.join(ids, "doc_id"), "labelled-ids")
    totals = {r[label]: r["n"] for r in known.groupBy(label).agg(F.sum("rows").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col(label) == x).orderBy(*order).limit(most).select("doc_id", label) for x in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(F.broadcast(saved(chosen[0].union(chosen[1]), "chosen-ids")), "doc_id"), totals


def kept_by_worker(name: Any, make: Callable[[], Any]) -> Any:
    """A value that a worker process makes once and keeps for its later tasks (read-only models, caches of pure functions)."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches cut to at most ``rows`` rows, so that Python holds few texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))
