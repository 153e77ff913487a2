"""Benchmark decontamination: containment search by size-partitioned MinHash sketches, verified by exact shingle containment.

A test item is contained in a document if the document holds at least ``THRESHOLD`` of the item's different shingles of five words. The
items are partitioned by their number of shingles. The sketch of an item in a class is its smallest shingle hashes, as many as a
document of that containment cannot miss all together: one more than the largest number of shingles that may be missing. So a document
that holds none of them does not contain the item, whatever its length, and no contained item is lost. A document only meets the classes
that it is large enough for. What the sketches bring up is verified on the words themselves.

Items are taken in blocks of a bounded size (``block_bytes``), which is what is collected and broadcast at a time; every block is searched
in one pass over the documents. The passes are independent, and a usual benchmark is one block.

Words are lower-cased runs of letters, digits and underscores. Defined results: null, empty and wordless texts contain nothing, and such
items are contained in nothing. With fewer than five words the whole sequence is the one shingle, so such an item is only found in a
document of exactly its words. Rows with one ``doc_id`` are one document in the result if either contains the item. Items of one text are
all reported. Null ids are reported as null. Empty tables give no row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import slices
from logsift.scratch import saved

WORDS, THRESHOLD = 5, 0.8
WORD = re.compile(r"\w+")
KEPT_WORDS = 100_000
TABLE_BITS = 20
MULTIPLIER = 0x9E3779B97F4A7C15
FOUND = "doc_id bigint, item_id bigint, containment double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(WORDS)), strict=False))


class Hasher:
    """64-bit hashes of words, kept between texts, and of their shingles."""

    def __init__(self) -> None:
        self.kept: dict[str, int] = {}

    def shingles(self, words: list[str]) -> np.ndarray:
        """A hash for each run of five words, or for the whole sequence if it is shorter."""
        from xxhash import xxh64_intdigest

        if not words:
            return np.zeros(0, dtype=np.uint64)
        if len(self.kept) >= KEPT_WORDS:
            self.kept.clear()
        kept = self.kept
        for word in [w for w in set(words) if w not in kept]:
            kept[word] = xxh64_intdigest(word.encode())
        hashes = np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        n = min(WORDS, len(words))
        found = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            found = (found ^ hashes[k : len(words) - n + 1 + k]) * np.uint64(MULTIPLIER)
            found ^= found >> np.uint64(29)
        return found


def missable(size: int) -> int:
    """How many of an item's shingles a document may miss and still contain it."""
    return max(m for m in range(size + 1) if size - m >= THRESHOLD * size - 1e-9)


@dataclass(frozen=True)
class SizeClass:
    """Items with about as many shingles: sketch hashes in order, and which item each of them belongs to."""

    least: int  # shingles of a document that can contain one of them
    hashes: np.ndarray
    items: np.ndarray
    table: np.ndarray  # whether a hash with these first bits is there


def size_classes(texts: list[str | None]) -> list[SizeClass]:
    """Sketches of items, in classes of sizes up to the next power of two."""
    hasher, by_class = Hasher(), {}
    for item, text in enumerate(texts):
        hashes = np.unique(hasher.shingles(words_of(text)))
        if len(hashes):
            sketch = hashes[: missable(len(hashes)) + 1]
            by_class.setdefault(len(hashes).bit_length(), []).append((item, len(hashes), sketch))
    classes = []
    for _, held in sorted(by_class.items()):
        hashes = np.concatenate([s for _, _, s in held])
        items = np.concatenate([np.full(len(s), item) for item, _, s in held])
        order = np.argsort(hashes, kind="stable")
        table = np.zeros(1 << TABLE_BITS, dtype=bool)
        table[hashes >> np.uint64(64 - TABLE_BITS)] = True
        classes.append(SizeClass(min(n - missable(n) for _, n, _ in held), hashes[order], items[order], table))
    return classes


def candidates(hashes: np.ndarray, classes: list[SizeClass]) -> set[int]:
    """Items whose sketch shares a hash with a document."""
    found: set[int] = set()
    for c in classes:
        if len(hashes) >= c.least:
            near = np.unique(hashes[c.table[hashes >> np.uint64(64 - TABLE_BITS)]])
            first, last = np.searchsorted(c.hashes, near, "left"), np.searchsorted(c.hashes, near, "right")
            for a, b in zip(first, last, strict=True):
                found.update(c.items[a:b].tolist())
    return found


def contained(text: str | None, hasher: Hasher, classes: list[SizeClass], items: list[set]) -> Iterator[tuple[int, float]]:
    """Items that a text contains, and how much of them."""
    words = words_of(text)
    near = candidates(hasher.shingles(words), classes)
    if near:
        held = shingles(words)
        for item in sorted(near):
            share = len(items[item] & held) / len(items[item])
            if share >= THRESHOLD - 1e-9:
                yield item, share


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, item_id, containment`` for every document of ``doc_id, text`` and item of ``item_id, text`` that it contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Items of one text are searched once, under their smallest id, and named again at the end.
    named = saved(items.where("text is not null").select(F.col("item_id").cast("long").alias("same"), F.col("text").cast("string").alias("item_text")), "items")
    texts = saved(named.groupBy("item_text").agg(F.min("same").alias("item_id")), "item-texts")
    size = texts.agg(F.sum(F.octet_length("item_text") + 64).alias("n")).first()["n"] or 0
    blocks = -(-size // block_bytes)
    # Made by the JVM: an empty list from Python starts workers of another kind, which stay beside those of the search.
    found = spark.range(0).selectExpr(*(f"CAST(NULL AS {kind}) AS {name}" for name, kind in (c.split() for c in FOUND.split(", "))))
    for block in range(blocks):
        part = texts.where(F.pmod(F.xxhash64("item_text"), F.lit(blocks)) == block).collect()
        found = found.union(_search(rows, [(r["item_id"], r["item_text"]) for r in part]))
    found = saved(found.groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment")), "contained")
    groups = named.join(texts, "item_text").select("item_id", "same")
    return found.join(groups, found["item_id"].eqNullSafe(groups["item_id"])).select("doc_id", F.col("same").alias("item_id"), "containment")


def _search(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """One pass over the documents for one block of items."""
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def searched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids, texts = [i for i, _ in shared.value], [t for _, t in shared.value]
        hasher, classes, sets = Hasher(), size_classes(texts), [shingles(words_of(t)) for t in texts]
        for batch in slices(batches, 256):
            hits = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                hits += [(doc_id, ids[item], share) for item, share in contained(text, hasher, classes, sets)]
            doc_ids, item_ids, shares = zip(*hits, strict=True) if hits else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(item_ids, pa.int64()), pa.array(shares, pa.float64())], ["doc_id", "item_id", "containment"])

    return rows.mapInArrow(searched, FOUND)
