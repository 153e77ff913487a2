"""Quality by the votes of the nearest labelled documents in a latent semantic space.

A document's terms are its words, the shapes of its words (letter case, digits, marks at either end, length) and its repetitions, hashed
into ``TERMS`` buckets. Weighted by inverse document frequency, the labelled documents' terms are projected to ``LATENT`` dimensions by a
singular value decomposition. Every document is placed there, the cosines with all labelled vectors are computed in blocks, and its
``NEIGHBOURS`` nearest vote for their labels with the weight of their similarity, each for as many given rows as it stands for.

The fit reads ``fit_rows`` labelled rows of either label at most, chosen by a hash of their id and text, and weights them back to the
labels as they were given; their term counts have a fixed size, so at most 2 x ``fit_rows`` x ``TERMS`` numbers reach the driver and
2 x ``fit_rows`` x ``LATENT`` are broadcast. Every row is scored over its whole text.

Defined results: a null or empty text has no term, its vector is zero, and all labelled vectors are equally near: it scores the share
of label 1 in the given rows. Without labels every score is 0.5; with one label all scores are that label. Ties between neighbours go to the first ones in
the order of their ids. Rows with a null id are scored but not learned from. An empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import opened, shared_value, slices, texts_of
from logsift.scratch import saved

TERMS, LATENT, NEIGHBOURS, SHARPNESS = 1024, 48, 25, 4
WORD_BUCKETS = 640  # of the terms; the rest are shapes, the last few repetitions
REPEATS = 8
KEPT_WORDS = 100_000
MARKS = re.compile(rb"[^0-9A-Za-z\x80-\xff]+$")


def terms_of(word: bytes) -> tuple[int, int]:
    """Buckets of a word and of its shape."""
    end = MARKS.search(word)
    tail = end[0][:3] if end else b""
    core = word[: len(word) - len(end[0])] if end else word
    case = b"A" if core.isupper() and len(core) > 1 else b"a" if core.islower() else b"Aa" if core[:1].isupper() else b"0" if core.isdigit() else b"?"
    size = min(len(core), 24) // 6
    shape = b"%b %b %d" % (case, tail, size)
    return zlib.crc32(core.lower()) % WORD_BUCKETS, WORD_BUCKETS + zlib.crc32(shape) % (TERMS - WORD_BUCKETS - REPEATS)


class Counter:
    """Term counts of texts, with the terms of words kept between texts."""

    def __init__(self) -> None:
        self.kept: dict[bytes, int] = {}  # both buckets in one number, as tuples take twice the memory

    def counts(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(TERMS, dtype=np.float32)
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        kept = self.kept
        for word in [w for w in set(words) if w not in kept]:
            of_word, of_shape = terms_of(word)
            kept[word] = of_word * TERMS + of_shape
        found = np.bincount(np.concatenate(np.divmod(np.array([kept[w] for w in words]), TERMS)), minlength=TERMS).astype(np.float32)
        # Repetitions: a word after itself, words used again, lines used again; each as a share of its own bucket.
        n = len(words)
        found /= n
        lines = text.split(b"\n")
        repeats = [sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n, 1 - len(set(lines)) / len(lines)]
        found[TERMS - REPEATS : TERMS - REPEATS + len(repeats)] = repeats
        return found


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of terms
    axes: np.ndarray  # terms x latent
    vectors: np.ndarray  # labelled documents, of length 1
    labels: np.ndarray
    stands: np.ndarray | None = None  # for how many given rows each labelled one does; without it, for one

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors of documents; zero for documents without terms."""
        latent = (np.sqrt(counts) * self.weight) @ self.axes
        length = np.linalg.norm(latent, axis=1, keepdims=True)
        return latent / np.where(length > 0, length, 1)

    def score(self, counts: np.ndarray, block: int = 2048) -> np.ndarray:
        """Votes of the nearest labelled documents, whose cosines are taken block by block."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        places = self.place(counts)
        k = min(NEIGHBOURS, len(self.labels))
        near, nearest = np.zeros((len(counts), 0)), np.zeros((len(counts), 0), dtype=np.int64)
        for at in range(0, len(self.labels), block):
            cosines = places @ self.vectors[at : at + block].T
            rows = np.broadcast_to(np.arange(at, at + cosines.shape[1]), cosines.shape)
            if cosines.shape[1] > k:
                best = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
                cosines, rows = np.take_along_axis(cosines, best, 1), np.take_along_axis(rows, best, 1)
            near, nearest = np.hstack([near, cosines]), np.hstack([nearest, rows])
            kept = np.argsort(-near, axis=1, kind="stable")[:, :k]
            near, nearest = np.take_along_axis(near, kept, 1), np.take_along_axis(nearest, kept, 1)
        stands = np.ones(len(self.labels)) if self.stands is None else self.stands
        weights = (np.maximum(near, 0) ** SHARPNESS + 1e-9) * stands[nearest]
        found = (weights * self.labels[nearest]).sum(axis=1) / weights.sum(axis=1)
        found[~counts.any(axis=1)] = np.average(self.labels, weights=stands)
        return np.clip(found, 0, 1)


def _counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Term counts of ``text`` as packed floats, beside the columns ``keep``."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter()
        for batch in slices(batches, 256):
            packed = [counter.counts(x).tobytes() for x in texts_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [pa.array(packed, pa.binary())], [*keep, "counts"])

    kinds = dict(docs.dtypes)
    return docs.select(*keep, "text").mapInArrow(counted, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", counts binary")


def fit(labelled: DataFrame, fit_rows: int = 3_000, given: dict[int, int] | None = None) -> Model:
    """A model of ``doc_id, text, quality`` (0 or 1; others are left out), which may be a sample of the ``given`` rows of either label."""
    rows = labelled.where("quality in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("quality").cast("int").alias("quality"))
    share = F.lit(0.0)
    totals = {r["quality"]: r["n"] for r in rows.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    for label, n in totals.items():
        share = F.when(F.col("quality") == label, F.lit(min(1.0, (1.2 * fit_rows + 100) / n))).otherwise(share)
    chosen = rows.withColumn("at", F.xxhash64("doc_id", "text")).where(F.pmod("at", F.lit(1_000_000)) < share * 1_000_000)
    held = saved(_counted(chosen, ["doc_id", "quality", "at"]), "term-counts")
    first = [held.where(F.col("quality") == x).orderBy("at", "doc_id").limit(fit_rows) for x in (0, 1)]
    found = sorted((r["doc_id"], r["quality"], r["counts"]) for r in first[0].union(first[1]).collect())
    totals = {x: (given or totals).get(x, n) for x, n in totals.items()}
    counts = np.frombuffer(b"".join(x[2] for x in found), dtype=np.float32).reshape(-1, TERMS)
    labels = np.array([x[1] for x in found], dtype=np.float32)
    if not len(labels):
        return Model(np.ones(TERMS, dtype=np.float32), np.zeros((TERMS, 1), dtype=np.float32), np.zeros((0, 1), dtype=np.float32), labels)
    held = {x: int((labels == x).sum()) for x in totals}
    stands = np.array([totals[int(x)] / held[int(x)] for x in labels])
    weight = np.log((1 + len(labels)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 0.1
    weighted = np.sqrt(counts) * weight
    _, _, axes = np.linalg.svd(weighted.T @ weighted)
    model = Model(weight, axes[:LATENT].T.astype(np.float32).copy(), np.zeros((0, 1), dtype=np.float32), labels)
    return Model(weight, model.axes, model.place(counts).astype(np.float32), labels, stands)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``doc_id, text``, from the text alone."""
    return _scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model, "score").drop("text")


def score_rows(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and the score as ``name``, in place of a column of that name."""
    return _scored(docs.drop(name), model, name)


def _scored(rows: DataFrame, model: Model, name: str) -> DataFrame:
    from pyspark.sql import types as T

    shared = shared_value(rows.sparkSession, model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter, model = Counter(), opened(shared)
        for batch in slices(batches, 256):
            counts = np.stack([counter.counts(x) for x in texts_of(batch, "text")])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(counts).astype(np.float64))], [*batch.schema.names, name])

    return rows.mapInArrow(scored, T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())]))
