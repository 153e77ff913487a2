"""Exact top-k by integer inner product: a ball tree per shard, searched by branch and bound for blocks of queries.

Vectors are dealt over shards of about ``SHARD`` rows by a hash, packed as one row each; queries into blocks of about ``BLOCK`` rows (fewer,
if vectors are long). Shards are dealt over groups: one each up to ``GROUPS``, then up to ``HELD`` shards a group, which one task holds. Every
block first searches one group. Its k-th scores there bound the answers from below and go with the block to all other groups, so those start
with the shared bound. In a shard, a node's upper bound is the product with its centre plus the query's length times the node's radius; the
better child comes first, and a node goes on only with the queries whose k-th score it can still reach.

A group's shards and the blocks that ask it are rows of one table, dealt by group and sorted, shards first. So vectors are on no side of a
join that Spark could broadcast, a shard is sent once a pass, and a block as often as there are groups: the bytes sent follow the input up to
``GROUPS * HELD`` shards. Nothing is gathered beyond k rows a query and shard.

Defined results: vectors that are null, empty or hold a null or non-finite component, and rows without an id, take no part; vectors of
different lengths are not compared. Repeated rows count once; rows of one id with different vectors are separate, and none of them is a
candidate of its own id. Ties go to the smaller id. Fewer candidates than k: all of them. An empty table gives no row.
Scores are exact while they and their parts stay below 2^63; above 2^53 they are added up as integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import shuffle_partitions
from logsift.scratch import saved

SHARD, BLOCK, LEAF = 8192, 1024, 64
GROUPS, HELD = 64, 16
NUMBERS = 64 * SHARD  # components in a shard, at most; a block has an eighth
FOUND = "query_id bigint, version bigint, vec_id bigint, vec_version bigint, score bigint"


def quantized(vector: str, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, x as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: str) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as doubles where every sum fits into 53 bits, else as 64-bit integers."""
    if not len(queries) or not len(rows):
        return np.zeros((len(queries), len(rows)), dtype=np.int64)
    most = float(np.abs(queries).max()) * float(np.abs(rows).max()) * queries.shape[1]
    if most < 2.0**53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    return queries @ rows.T


class BallTree:
    """Balls around the rows of a shard: halved at the median of the widest direction until ``LEAF`` rows are left."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors = vectors
        self.order = np.arange(len(vectors))
        self.nodes: list[tuple] = []  # centre, radius, first, last, children or None
        self.grow(0, len(vectors))

    def grow(self, first: int, last: int) -> int:
        rows = self.vectors[self.order[first:last]].astype(np.float64)
        centre = rows.mean(axis=0)
        away = np.linalg.norm(rows - centre, axis=1)
        at = len(self.nodes)
        self.nodes.append((centre, float(away.max()), first, last, None))
        if last - first > LEAF and away.max() > 0:
            pole = rows[away.argmax()]
            other = rows[np.linalg.norm(rows - pole, axis=1).argmax()]
            along = np.argsort(rows @ (other - pole), kind="stable")
            self.order[first:last] = self.order[first:last][along]
            middle = (first + last) // 2
            children = self.grow(first, middle), self.grow(middle, last)
            self.nodes[at] = (*self.nodes[at][:4], children)
        return at

    def bounds(self, node: int, queries: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What no score in the node exceeds; a little more, for rounding."""
        centre, radius = self.nodes[node][:2]
        near = queries @ centre
        return near + lengths * radius + 1e-9 * (np.abs(near) + lengths * radius) + 1e-6


def search(tree: BallTree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and scores of the k best rows for every query (-1: fewer), given a lower bound of its k-th score."""
    n = len(queries)
    best, score = np.full((n, k), -1), np.full((n, k), np.iinfo(np.int64).min)
    kth = kth.astype(np.float64).copy()
    floats = queries.astype(np.float64)
    lengths = np.linalg.norm(floats, axis=1)

    def visit(node: int, active: np.ndarray, upper: np.ndarray) -> None:
        active = active[upper >= kth[active]]  # a tie may still have a smaller id
        if not len(active):
            return
        *_, first, last, children = tree.nodes[node]
        if children:
            ahead = sorted(((tree.bounds(c, floats[active], lengths[active]), c) for c in children), key=lambda x: -x[0].sum())
            for bound, child in ahead:
                visit(child, active, bound)
            return
        for at in range(first, last, 4096):  # a leaf of equal rows may be large
            rows = tree.order[at : min(last, at + 4096)]
            found = products(queries[active], tree.vectors[rows])
            found = np.where(own[active][:, None] == ids[rows][None, :], np.iinfo(np.int64).min, found)
            most = found.max(axis=1)
            for i in np.flatnonzero((most >= score[active, -1]) & (most >= kth[active])):
                q = active[i]
                both_rows = np.concatenate([best[q], rows])
                both = np.concatenate([score[q], found[i]])
                kept = np.lexsort((np.where(both_rows >= 0, ids[both_rows], np.iinfo(np.int64).max), ~both))[:k]
                both_rows = np.where(both == np.iinfo(np.int64).min, -1, both_rows)
                best[q], score[q] = both_rows[kept], both[kept]
                if best[q, -1] >= 0:
                    kth[q] = max(kth[q], score[q, -1])

    everyone = np.arange(n)
    if n and len(tree.vectors):
        visit(0, everyone, tree.bounds(0, floats, lengths))
    return best, score


def search_all(trees: list[tuple[BallTree, np.ndarray]], queries: np.ndarray, own: np.ndarray, kth: np.ndarray, k: int) -> list[tuple[np.ndarray, ...]]:
    """For every tree: queries, rows and scores (by number) of what may be among the k best of all trees, which share their bounds."""
    none = np.iinfo(np.int64).min
    kth, top, found = kth.astype(np.float64), np.full((len(queries), k), none), []
    for tree, ids in trees:
        best, score = search(tree, ids, queries, own, kth, k)
        found.append((best, score))
        top = np.sort(np.concatenate([top, np.where(best >= 0, score, none)], axis=1), axis=1)[:, -k:]
        kth = np.where(top[:, 0] > none, np.maximum(kth, top[:, 0].astype(np.float64)), kth)
    out = []
    for best, score in found:
        query, place = np.nonzero((best >= 0) & (score.astype(np.float64) >= kth[:, None]))
        out.append((query, best[query, place], score[query, place]))
    return out


def _numbers(batch, name: str, at: int) -> np.ndarray:
    """The numbers in one row's list, or list of lists, without Python objects."""
    held = batch.column(name).slice(at, 1).flatten()
    while hasattr(held.type, "value_type"):
        held = held.flatten()
    return held.to_numpy(zero_copy_only=False)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row of ``vec_id, embedding`` that ``is_query``, its k best other rows."""

    def found(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, shards, trees = None, [], []
        for batch in batches:
            dims, groups, places = (batch.column(c).to_pylist() for c in ("dim", "group", "shard"))
            for at, shard in enumerate(places):
                ids, versions = _numbers(batch, "ids", at), _numbers(batch, "versions", at)
                rows = _numbers(batch, "vectors", at).reshape(len(ids), -1)
                if group != (dims[at], groups[at]):  # rows of a group follow one another, shards first
                    group, shards, trees = (dims[at], groups[at]), [], []
                if shard is not None:
                    shards.append((rows.copy(), ids.copy(), versions.copy()))
                    continue
                trees += [(BallTree(r), i) for r, i, _ in shards[len(trees) :]]
                answers = search_all(trees, rows, ids, _numbers(batch, "kth", at), k)
                for (query, hit, score), (_, hit_ids, hit_versions) in zip(answers, shards, strict=True):
                    arrays = [ids[query], versions[query], hit_ids[hit], hit_versions[hit], score]
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["query_id", "version", "vec_id", "vec_version", "score"])

    # Whether a row is a query is asked of the row itself, whatever its other columns are called.
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    whole = rows.where(F.col("vec_id").isNotNull() & usable("v")).select("vec_id", quantized("v", scale).alias("q"), "asks")
    kept = saved(whole.select("vec_id", "q", F.xxhash64("q").alias("version"), F.size("q").alias("dim"), F.coalesce("asks", F.lit(False)).alias("asks")).distinct(), "vectors")
    most = lambda rows, numbers: F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(numbers) / F.col("dim"))))
    counts = kept.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("asked"))
    counts = counts.select("dim", F.ceil(F.col("n") / most(SHARD, NUMBERS)).alias("shards"), F.ceil(F.col("asked") / most(BLOCK, NUMBERS // 8)).alias("blocks"))
    groups = F.least("shards", F.greatest(F.lit(GROUPS), F.ceil(F.col("shards") / HELD)))
    counts = saved(counts.select("*", groups.alias("groups")), "counts")  # a row for each length of vector

    def dealt(kept: DataFrame, number: str, into: str) -> DataFrame:
        """Rows of one length packed into pieces of bounded size by a hash of the row."""
        at = F.pmod(F.xxhash64("vec_id", "version", F.lit(number)), F.greatest(F.col(into), F.lit(1))).alias(number)
        placed = kept.join(F.broadcast(counts), "dim").where("blocks > 0").select("dim", "groups", "blocks", at, F.struct("vec_id", "version", "q").alias("row"))
        packed = placed.groupBy("dim", "groups", "blocks", number).agg(F.array_sort(F.collect_list("row")).alias("rows"))
        return packed.select("dim", "groups", "blocks", number, F.col("rows.vec_id").alias("ids"), F.col("rows.version").alias("versions"), F.col("rows.q").alias("vectors"))

    shards = saved(dealt(kept, "shard", "shards").withColumn("group", F.pmod("shard", "groups")), "shards")
    blocks = saved(dealt(kept.where("asks"), "block", "blocks"), "blocks")

    def answers(shards: DataFrame, asked: DataFrame) -> DataFrame:
        columns = ["dim", "group", "ids", "versions", "vectors"]
        held = shards.select(*columns, "shard", F.lit(None).cast("array<double>").alias("kth"))
        both = held.union(asked.select(*columns, F.lit(None).cast("bigint").alias("shard"), "kth"))
        together = both.repartition(shuffle_partitions(both.sparkSession), "dim", "group")
        return together.sortWithinPartitions("dim", "group", F.col("shard").asc_nulls_last()).mapInArrow(found, FOUND)

    # A first group for each block; what it scores k-th there bounds the answers from below everywhere.
    least = F.transform("ids", lambda _: F.lit(float("-inf")))
    home = F.pmod("block", "groups")
    first = saved(answers(shards.where("group < blocks"), blocks.select("*", home.alias("group"), least.alias("kth"))), "first")
    reached = first.groupBy("query_id", "version").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    one = blocks.select("dim", "block", F.posexplode(F.arrays_zip("ids", "versions")).alias("at", "q"))
    bounds = one.select("dim", "block", "at", F.col("q.ids").alias("query_id"), F.col("q.versions").alias("version")).join(reached, ["query_id", "version"], "left")
    kths = bounds.groupBy("dim", "block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("least").cast("double"), F.lit(float("-inf"))).alias("kth")))).alias("kths"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1), lambda g: g != home)
    # Spark takes the blocks to be few bytes; they are merged, not broadcast.
    asked = blocks.where("groups > 1").join(kths.hint("merge"), ["dim", "block"]).select("*", F.col("kths.kth").alias("kth")).select("*", F.explode(others).alias("group"))
    every = first.union(answers(shards.where("groups > 1"), asked))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "version").orderBy(F.desc("score"), "vec_id", "vec_version")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
