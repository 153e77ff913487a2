"""SimHash near duplicates: fingerprints as points of per-segment bit counts, met on a grid, verified exactly.

A fingerprint is cut into 32 segments of two bits. Its point has the bit count (0, 1 or 2) of each; counts are written in unary, so the
Manhattan distance of two points is the number of bits in which their codes differ, and never more than the Hamming distance. Within
Manhattan distance 2, two of four blocks of coordinates agree, so a cell of the grid is a pair of blocks and their coordinates, and
every fingerprint lies in six cells. Pairs of a cell within Manhattan distance 2 are verified by their Hamming distance.

Cells with more than ``CROWD`` different fingerprints (large groups of near copies) emit no pairs. Their fingerprints meet at points
one flipped bit away: two fingerprints are within 2 bits exactly if they share such a point, so 65 rows each give the same components.

Copies of a text have one fingerprint, and only different fingerprints are searched. No step gathers a group in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import slices, texts_of
from logsift.llm.components import components
from logsift.scratch import saved

RADIUS = 2
CROWD = 64
AT_ONCE = 1 << 15  # shingles whose bits are counted at once
LOW_OF_TWO = 0x5555555555555555


def fingerprint(text: bytes, words: int) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased, as an unsigned number. Fewer words: one shingle; none: 0."""
    from xxhash import xxh64_intdigest

    found = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    runs = [found[k:] for k in range(words)] if len(found) >= words else [[b" ".join(found)]]
    counts, n = np.zeros(64, dtype=np.int64), len(runs[-1])
    for at in range(0, n, AT_ONCE):
        shingles = map(b" ".join, zip(*(run[at : at + AT_ONCE] for run in runs), strict=False))
        hashes = np.fromiter((xxh64_intdigest(x, 42) for x in shingles), dtype=np.uint64)
        counts += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in slices(batches, 256):
            found = np.array([fingerprint(x, words) for x in texts_of(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(hashed, "doc_id bigint, fp bigint")


def point(fp: str) -> Column:
    """Bit counts of the two-bit segments in unary: the low bit of a segment is set from 1 on, the high bit at 2."""
    x, halves = F.col(fp), F.lit(LOW_OF_TWO)
    shifted = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(shifted).bitwiseAND(halves).bitwiseOR(F.shiftleft(x.bitwiseAND(shifted).bitwiseAND(halves), 1))


def distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` between different fingerprints ``fp`` that join all within 2 bits. Inside crowded cells only as many as join them."""
    blocks = [0xFFFF << (16 * k) for k in range(RADIUS + 2)]
    masks = [x | y for k, x in enumerate(blocks) for y in blocks[k + 1 :]]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    grid = F.array(*(F.struct(F.lit(k).alias("pair"), F.col("point").bitwiseAND(F.lit(m)).alias("at")) for k, m in enumerate(signed)))
    cells = fps.select("fp", point("fp").alias("point")).select("fp", "point", F.explode(grid).alias("cell")).select("fp", "point", "cell.pair", "cell.at")
    shared = saved(cells.groupBy("pair", "at").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-cells")
    members = saved(cells.join(shared, ["pair", "at"]), "cells")

    few = members.where(F.col("n") <= CROWD)
    other = few.select("pair", "at", F.col("fp").alias("fp2"), F.col("point").alias("point2"))
    near = few.join(other, ["pair", "at"]).where("fp < fp2").where(distance("point", "point2") <= RADIUS)
    verified = near.where(distance("fp", "fp2") <= RADIUS).select(F.col("fp").alias("a"), F.col("fp2").alias("b"))

    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)))
    crowded = members.where(F.col("n") > CROWD).select("fp").distinct()
    meeting = crowded.select("fp", F.explode(F.transform(flips, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("via"))
    first = meeting.groupBy("via").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.collect_set("fp").alias("all"))  # 65 at most
    stars = first.where("a < b").select("a", F.explode("all").alias("b")).where("a <> b")
    return verified.union(stars).distinct()


def near_groups(docs: DataFrame, words: int = 3) -> DataFrame:
    """``doc_id, fingerprint`` (16 hex digits) ``, component_id`` of every row of ``doc_id, text``.

    A component is what links of at most 2 differing bits join; its id is the smallest ``doc_id`` in it.

    Defined results: null, empty and blank texts have fingerprint zero, linked like any other. Rows with one ``doc_id`` are separate
    members; a row without an id gets its component, too, and names it only if no row in it has an id (null). An empty table stays empty;
    other columns are ignored.
    """
    rows = saved(fingerprints(docs, words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    joined = components(links(fps))
    # Tables of their own, so that joins on a hot component or fingerprint have an exchange on either side and can be split.
    labelled = fps.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    labelled = saved(labelled, "labelled")
    named = saved(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "named")
    of_fp = labelled.select("fp", "component").join(named, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
