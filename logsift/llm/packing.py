"""Packing along a space-filling curve: documents of similar words become neighbours and share sequences.

Each document's ids are hashed into a count vector, projected to ``DIMENSIONS`` coordinates by fixed signs and placed on a Hilbert
curve. A long document goes on in rows of one sequence's length, so that ranges of as many rows are alike in size. Rows are
range-partitioned by their place; every task lays its documents end to end and cuts a sequence at each 2,048 ids. What
is left at the end of a task is cut into powers of two, which need no padding. Ties on the curve (copies) are ordered and split between
tasks by ``doc_id``.

Defined results: a null or empty text has only the end id; repeated rows are packed each; an empty table gives no piece; every id lies
in exactly one piece; other columns are ignored. A sequence id is the task's number times 2^40 plus a number within the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import slices, texts_of
from logsift.llm.tokens import KEPT_WORDS, encoder, wide
from logsift.scratch import saved

DIMENSIONS, BITS, BUCKETS = 4, 8, 256
ENCODED = "doc_id bigint, curve bigint, tie bigint, start bigint, doc_tokens bigint, ids binary, id_bytes int"
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) with ``bits`` bits a coordinate, by Skilling's transposition."""
    x = [points[:, k].astype(np.int64) for k in range(points.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for k in range(len(x)):
            inside = (x[k] & q) != 0
            swap = np.where(inside, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[0]
        q >>= 1
    for k in range(1, len(x)):
        x[k] = x[k] ^ x[k - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [c ^ flip for c in x]
    place = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            place = (place << 1) | ((c >> bit) & 1)
    return place


def curve_places(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert places of documents from the counts of their hashed ids. No id: the centre of the cube."""
    signs = np.random.default_rng(0).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))
    counts = np.stack([np.bincount((x.astype(np.int64) * 40503 >> 4) & (BUCKETS - 1), minlength=BUCKETS) for x in ids])
    vectors = np.log1p(counts)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    flat = (vectors / np.where(lengths, lengths, 1)) @ signs / 2
    return hilbert(np.minimum(((np.tanh(flat) + 1) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def powers(n: int) -> list[int]:
    """The powers of two that add up to ``n``, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, room: int = 2048, range_ids: int = 1 << 22, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Pieces of ``doc_id, text`` in sequences of at most ``room`` ids (a power of two): which ids, in which sequence, at which offset.

    A range of the curve holds about ``range_ids`` ids, so there are as many tasks as the size asks for and none grows with it.
    A worker keeps the ids of at most ``kept_words`` words: fewer take less memory and more time.
    """

    def encoded(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encode = encoder(tokenizer, kept_words)
        end = np.array([end_id], dtype=encode.kind).tobytes()
        for batch in slices(batches, 256):
            packed = [encode.encode(x) + end for x in texts_of(batch, "text")]
            ids = [np.frombuffer(x, encode.kind) for x in packed]
            places = curve_places([x[:-1] for x in ids])
            rows = []
            for doc_id, place, x, whole in zip(batch.column("doc_id").to_pylist(), places.tolist(), packed, ids, strict=True):
                tie, step = zlib.crc32(x), room * len(end)
                rows += [(doc_id, place, tie, at // len(end), len(whole), x[at : at + step], len(end)) for at in range(0, len(x), step)]
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()
            names = ["doc_id", "curve", "tie", "start", "doc_tokens", "ids", "id_bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def pieces(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        base, number, used = TaskContext.get().partitionId() << 40, 0, 0
        open_pieces: list[tuple] = []  # of the sequence that is being filled
        done: list[tuple] = []

        def flushed():
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in slices(batches, 256):
            columns = (batch.column(k).to_pylist() for k in ("doc_id", "start", "doc_tokens", "ids", "id_bytes"))
            for doc_id, first, total, packed, size in zip(*columns, strict=True):
                at, held, kind = 0, len(packed) // size, f"<u{size}"
                while at < held:
                    length = min(room - used, held - at)
                    part = wide(packed[at * size : (at + length) * size], kind)
                    last = open_pieces[-1] if open_pieces else None
                    if last and (last[0], last[1] + last[2], last[4]) == (doc_id, first + at, total):
                        open_pieces[-1] = (doc_id, last[1], last[2] + length, last[3] + part, total, *last[5:])
                    else:
                        open_pieces.append((doc_id, first + at, length, part, total, base + number, used))
                    at, used = at + length, used + length
                    if used == room:
                        done += open_pieces
                        number, used, open_pieces = number + 1, 0, []
                if len(done) >= 1024:
                    yield flushed()
                    done = []
        for size in powers(used):
            offset = 0
            while offset < size:
                doc_id, start, length, part, total, *_ = open_pieces.pop(0)
                taken = min(length, size - offset)
                done.append((doc_id, start, taken, part[: 4 * taken], total, base + number, offset))
                if taken < length:
                    open_pieces.insert(0, (doc_id, start + taken, length - taken, part[4 * taken :], total, 0, 0))
                offset += taken
            number += 1
        if done:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    placed = saved(rows.mapInArrow(encoded, ENCODED), "placed")
    order = ["curve", "doc_id", "tie", "start"]
    ranges = (placed.where("start = 0").agg(F.sum("doc_tokens")).first()[0] or 0) // range_ids + 1
    ranged = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(pieces, PIECES)
