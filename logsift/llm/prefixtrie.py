"""Conversation prefix trie by whole-sequence collapse.

Turns are numbered within their conversation; a prefix is known by two 64-bit sums (exclusive or) of hashes of its turns and their
places, so a sequence's hash needs no order and the hashes of all its prefixes are one running sum. Identical conversations collapse
into one weighted sequence under their smallest id, with the list of all ids that end there. Only the sequences' own prefixes are looked
at after that. Those that are proper prefixes of another sequence are dropped by an anti-join; the others are the leaves.

A node's figures are sums over the weighted sequences through it, so no pair of a node and its descendant is made. For ``saved_tokens``
a subtree's sum of ``(n_convs - 1) * bytes`` falls into two: bytes by members is each sequence's weight times its bytes from the node
on; bytes by nodes counts each node once, under the sequence of its smallest member. The nodes of one such sequence are the last ones of
its path, so it adds to a node above them all their bytes, and to a node among them those from there on.

No key is held whole by a task: a long conversation is cut into ranges (``scans``), prefixes are aggregated before the shuffle, the
joins with hot keys lie between written tables, whose parts adaptive execution splits. The id list of one end is hashed in order by one
task, for SHA-256 allows nothing else; it streams through lists of ``CHUNK`` ids that were joined before.

Defined results: rows without ``conv_id`` are left out. Null roles and texts are empty. Turns are ordered by ``turn``, null first, and
where turns are equal by a hash of role and text; repeated rows are turns of their own. A conversation whose rebuilt form has no turn
ends at the root. An empty table has no root and gives no row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.scans import added, range_sorted, running, xored
from logsift.scratch import saved

CHUNK = 1024
NODE = ["depth", "x", "y"]


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, place (from 1), a, b (hashes of role and text), bytes`` for every turn of a known conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashes = [F.xxhash64(F.lit(salt), role, text).alias(name) for salt, name in ((1, "a"), (2, "b"))]
    slim = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *hashes, F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"))
    order = [F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    rows = range_sorted(slim, [F.col("conv_id"), *order], "turns")
    return saved(running(rows, ["conv_id"], order, {"place": added("one")}).select("conv_id", "place", "a", "b", "bytes"), "places")


def heads_by_crc(conv_id: Column, ways: int = 9) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % ways


def rebuilt(turns: DataFrame, group: int = 5, ways: int = 9) -> DataFrame:
    """``conv_id, depth, a, b, bytes`` of the turns of every conversation after its head was replaced, and a row of depth 0 for each.

    The first ``crc32(id) % ways`` turns come from the conversation with the next lower multiple of ``group`` as its id, or all it has.
    A head is met by the conversations of one group only.
    """
    places = ordered_turns(turns)
    base, head = F.col("conv_id") - F.col("conv_id") % group, heads_by_crc(F.col("conv_id"), ways)
    convs = saved(places.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns")), "conversations")
    bases = convs.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.col("turns").alias("base_turns"))
    known = convs.select("conv_id", base.alias("base"), head.alias("head")).join(bases, "base", "left")
    known = saved(known.withColumn("taken", F.least("head", F.coalesce("base_turns", F.lit(0)))).select("conv_id", "base", "head", "taken"), "heads")
    own = places.join(known, "conv_id").where("place > head").select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "a", "b", "bytes")
    first = places.where((F.col("conv_id") % group == 0) & (F.col("place") < ways)).select(F.col("conv_id").alias("base"), "place", "a", "b", "bytes")
    lent = known.join(first, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "a", "b", "bytes")
    none = F.lit(0).cast("long")
    roots = known.select("conv_id", none.alias("depth"), none.alias("a"), none.alias("b"), none.alias("bytes"))
    return saved(own.union(lent).union(roots), "rebuilt")


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, x, y, bytes``: the length and hash of every conversation of rebuilt turns with their places hashed in."""
    whole = turns.groupBy("conv_id").agg(F.max("depth").alias("depth"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"), F.sum("bytes").alias("bytes"))
    return saved(whole, "sequences")


def end_lists(whole: DataFrame) -> DataFrame:
    """``depth, x, y, ends_sha256``: SHA-256 of the ascending ids, joined by commas, of the conversations of each sequence."""

    def hashed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([(c, pa.int64()) for c in NODE] + [("ends_sha256", pa.string())])
        held, digest = None, None
        done: list[dict] = []
        for batch in batches:
            for depth, x, y, ids in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if (depth, x, y) == held:
                    digest.update(b",")
                else:
                    if held is not None:
                        done.append(dict(zip(NODE, held, strict=True), ends_sha256=digest.hexdigest()))
                    held, digest = (depth, x, y), hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
                done = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(NODE, held, strict=True), ends_sha256=digest.hexdigest())], schema=schema)

    rows = range_sorted(whole.select(*NODE, "conv_id"), [F.col(c) for c in (*NODE, "conv_id")], "ends")
    place = F.row_number().over(Window.partitionBy("range", *NODE).orderBy("conv_id"))
    chunks = rows.withColumn("chunk", F.floor((place - 1) / CHUNK)).groupBy("range", *NODE, "chunk").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = chunks.select(*NODE, "range", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    streams = joined.repartition(*NODE).sortWithinPartitions(*NODE, "range", "chunk").select(*NODE, "ids")
    return saved(streams.mapInArrow(hashed, "depth bigint, x bigint, y bigint, ends_sha256 string"), "end-lists")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row per node of the trie of ``rebuilt`` turns: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    keyed = turns.select("conv_id", "depth", "bytes", *(F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(h, "depth")).alias(n) for h, n in (("a", "x"), ("b", "y"))))
    whole = sequences(keyed)
    weighted = saved(whole.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.min("bytes").alias("total")), "weighted")

    # Prefixes of one conversation for each sequence: hashes and bytes up to there.
    chosen = keyed.join(weighted.select("conv_id"), "conv_id", "left_semi").select("conv_id", "depth", "bytes", F.col("x").alias("turn_x"), F.col("y").alias("turn_y"))
    rows = range_sorted(chosen, [F.col("conv_id"), F.col("depth")], "paths")
    paths = running(rows, ["conv_id"], [F.col("depth")], {"x": xored("turn_x"), "y": xored("turn_y"), "upto": added("bytes")})
    paths = saved(paths.select("conv_id", *NODE, F.col("x").bitwiseXOR(F.col("turn_x")).alias("up_x"), F.col("y").bitwiseXOR(F.col("turn_y")).alias("up_y"), "bytes", "upto"), "prefixes")

    owners = saved(paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes")), "owners")
    owned = owners.groupBy("conv_id").agg(F.min("depth").alias("from_depth"), F.sum("bytes").alias("owned"))
    lengths = weighted.select("conv_id", F.col("depth").alias("length"))
    proper = paths.join(lengths, "conv_id").where("depth < length").select(*NODE).distinct()
    leaves = weighted.join(proper, NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    facts = saved(weighted.select("conv_id", "n", "total").join(owned, "conv_id", "left").join(leaves, "conv_id", "left"), "facts")

    after = F.col("total") - F.col("upto") + F.col("bytes")
    once = F.when(F.col("depth") >= F.col("from_depth"), after).otherwise(F.coalesce("owned", F.lit(0)))
    through = paths.join(facts, "conv_id").select("conv_id", *NODE, "up_x", "up_y", "n", F.coalesce("leaf", F.lit(0)).alias("leaf"), (F.col("n") * after - once).alias("saved"))
    sums = [F.min("conv_id").alias("conv_id"), F.min("up_x").alias("up_x"), F.min("up_y").alias("up_y"), F.sum("n").alias("n_convs"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")]
    nodes = saved(through.groupBy(*NODE).agg(*sums), "nodes")

    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y"))
    children = up.agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("parent_conv_id"))
    placed = saved(nodes.join(parents, ["depth", "up_x", "up_y"], "left"), "placed")
    full = placed.join(children, NODE, "left").join(end_lists(whole), NODE, "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
