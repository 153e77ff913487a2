"""Token ids in blocks: one concatenated id array each, document boundaries in Elias-Fano code.

A block is a row of a Parquet table (``part``, ``block``, ``first``, ``n_ids``, ``doc_ids``, ``data``). ``data`` is the file format:
a header, samples for selecting, the low bits, the high bits in unary, the ids in 2 or 4 bytes. Boundaries take about
2 + log2(ids / documents) bits each; no table of 64-bit offsets is written.

Defined results: a null or empty text has only the end id. Rows are ordered by ``doc_id`` (null first), rows of one id by a hash of
the text and the text; repeated rows stay. An empty table gives no block. Other columns are not stored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import shuffle_partitions, slices, texts_of
from logsift.llm.tokens import encoder, wide

HEADER = "<4sBBxxQQQQ"  # magic, id bytes, low bits, documents, ids, bytes of low and of high bits
MAGIC = b"EFI1"
SAMPLE = 256
BLOCKS = "part int, block int, first long, n_ids long, doc_ids array<bigint>, data binary"
DOCUMENTS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class EliasFano:
    """A rising sequence: ``select(i)`` reads one value, ``all()`` every value."""

    def __init__(self, n: int, low_bits: int, samples: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.n, self.low_bits, self.samples, self.low, self.high = n, low_bits, samples, low, high

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> low_bits) + np.arange(n)
        unary = np.zeros(int(universe >> low_bits) + n + 1, dtype=np.uint8)
        unary[ones] = 1
        low = np.packbits((values[:, None] >> np.arange(low_bits)).astype(np.uint8) & 1, bitorder="little")
        return cls(n, low_bits, ones[::SAMPLE].astype("<u4"), low, np.packbits(unary, bitorder="little"))

    def select(self, i: int) -> int:
        """The ``i``-th value: from the sampled one bit before it, count on to its own."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, skipped = at // 8, at % 8
        bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        bits[:skipped] = 0
        while (found := int(bits.sum())) <= left:
            left, byte = left - found, byte + 64
            bits = np.unpackbits(self.high[byte : byte + 64], bitorder="little")
        one = byte * 8 + int(np.flatnonzero(bits)[left])
        first = i * self.low_bits
        low = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 :][: self.low_bits]
        return ((one - i) << self.low_bits) | sum(int(b) << k for k, b in enumerate(low))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (ones - np.arange(self.n)) << self.low_bits
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return values + (low.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def to_block(ids: list[bytes], kind: str) -> bytes:
    """Packed ids of documents, in order, as one block."""
    size = np.dtype(kind).itemsize
    ends = np.cumsum([len(x) // size for x in ids], dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    code = EliasFano.of(ends, total)
    head = struct.pack(HEADER, MAGIC, size, code.low_bits, len(ids), total, len(code.low), len(code.high))
    return b"".join([head, code.samples.tobytes(), code.low.tobytes(), code.high.tobytes(), *ids])


def from_block(data: bytes) -> tuple[EliasFano, np.ndarray]:
    """The document ends and all ids of a block."""
    magic, size, low_bits, n, total, low, high = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at, samples = struct.calcsize(HEADER), -(-n // SAMPLE)
    sampled = np.frombuffer(data, "<u4", samples, at)
    lows = np.frombuffer(data, np.uint8, low, at + 4 * samples)
    highs = np.frombuffer(data, np.uint8, high, at + 4 * samples + low)
    return EliasFano(n, low_bits, sampled, lows, highs), np.frombuffer(data, f"<u{size}", total, at + 4 * samples + low + high)


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1 << 20) -> None:
    """Write the ids of ``doc_id, text`` in ascending ``doc_id`` order: one range of ids a task, blocks of about ``block_ids`` ids."""

    def blocks(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        end = np.array([end_id], dtype=encode.kind).tobytes()
        number = first = held = 0
        doc_ids: list = []
        ids: list[bytes] = []

        def block():
            row = [part], [number], [first], [held], [doc_ids], [to_block(ids, encode.kind)]
            kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()
            names = ["part", "block", "first", "n_ids", "doc_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in slices(batches, 256):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch, "text"), strict=True):
                packed = encode.encode(text) + end
                doc_ids.append(doc_id)
                ids.append(packed)
                held += len(packed) // len(end)
                if held >= block_ids:
                    yield block()
                    number, first, held, doc_ids, ids = number + 1, first + held, 0, [], []
        if ids:
            yield block()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order, "text")
    ranged.select("doc_id", "text").mapInArrow(blocks, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written blocks: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (32-bit, little-endian)."""

    def documents(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 1):
            row = {k: v[0] for k, v in batch.to_pydict().items()}
            code, ids = from_block(row["data"])
            ends = code.all()
            starts = np.concatenate([[0], ends[:-1]])
            for at in range(0, len(ends), 1024):
                near, far = starts[at : at + 1024], ends[at : at + 1024]
                packed = [wide(ids[a:b].tobytes(), ids.dtype.str) for a, b in zip(near, far, strict=True)]
                arrays = [pa.array(row["doc_ids"][at : at + 1024], pa.int64()), pa.array(near + row["start"]), pa.array(far - near), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.parquet(path)
    # One row for each task of the write: small enough for one window and for a broadcast.
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).select("part", before.alias("base"))
    placed = blocks.join(F.broadcast(bases), "part").select((F.col("first") + F.col("base")).alias("start"), "doc_ids", "data")
    return placed.mapInArrow(documents, DOCUMENTS)
