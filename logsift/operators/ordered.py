"""Ordered work on groups of any size.

A window over one key is one task, however many rows the key has. The helpers here cut every key into
blocks that follow the order (so many rows of a log, a stretch of a file), do the ordered work inside the blocks,
and carry the result across block edges with a second window over one row per block. A key with a third
of all rows then spreads over as many tasks as it has blocks. The results are exact. Key and block
columns must not be NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.times import micros


_NO_TIME = -(1 << 61)


def row_blocks(df: DataFrame, rows: int, most: int = 1024, name: str = "_block", ts: str = "ts", seq: str = "seq") -> DataFrame:
    """Add the number of a block of about ``rows`` rows, following the order of ``ts, seq`` (both NULL first).

    The cuts are quantiles of the time, ``most`` at the most, so a block stays a small share of the table however the times lie. A time
    with more rows than a block (a burst, rows without a time) is cut once more, by quantiles of ``seq`` over all such rows. Quantiles are
    merged from partial sums, and only the cuts come to the driver.
    """
    moment, turn = (F.coalesce(c.cast("bigint"), F.lit(_NO_TIME)) for c in (micros(ts), F.col(seq)))
    steps, close = [k / most for k in range(1, most)], 4 * most
    found = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(moment, steps, close).alias("cuts")).first()
    wanted = min(most, found["n"] // rows + 1)
    thinned = lambda cuts: [cuts[k * most // wanted - 1] for k in range(1, wanted)]
    cuts = thinned(found["cuts"]) if wanted > 1 else []
    crowded = sorted({a for a, b in zip(cuts, cuts[1:], strict=False) if a == b})
    # A crowded time opens its block, so what else is in the block comes later.
    within = F.lit(most)
    if crowded:
        burst = moment.isin(crowded)
        turns = thinned(df.where(burst).agg(F.percentile_approx(turn, steps, close).alias("cuts")).first()["cuts"])
        within = F.when(burst, _place(turn, turns)).otherwise(within)
    return df.withColumn(name, (_place(moment, cuts) * (most + 1) + within).cast("bigint"))


def _place(value: Column, cuts: Sequence[int]) -> Column:
    """How many different cuts are not above the value, looked up in two steps: a group of cuts, then the cuts of that group."""
    cuts = sorted(set(cuts))
    if not cuts:
        return F.lit(0).cast("bigint")
    width = math.isqrt(len(cuts)) + 1
    groups = [cuts[at : at + width] for at in range(0, len(cuts), width)]
    listed = lambda numbers: f"array({', '.join(f'{n}L' for n in numbers)})"

    def found(value: Column) -> Column:
        reached = lambda numbers: F.size(F.filter(numbers, lambda c: c <= value)).cast("bigint")
        group = reached(F.expr(listed(g[0] for g in groups)))
        inside = reached(F.get(F.expr(f"array({', '.join(listed(g) for g in groups)})"), group - 1))
        return F.when(group == 0, F.lit(0).cast("bigint")).otherwise((group - 1) * width + inside)

    # Bound first: the optimizer carries columns that stand inside a lambda over to the other side of a self-join, which lacks them.
    return F.element_at(F.transform(F.array(value), found), 1)


def previous_row(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], fields: Sequence[str], name: str = "prev") -> DataFrame:
    """Add struct ``name``: ``fields`` of the row before this one under the same keys, NULL for the first."""
    inside = W.partitionBy(*keys, block).orderBy(*order)
    marked = df.withColumn(name, F.lag(F.struct(*fields)).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    last = df.groupBy(*keys, block).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(W.partitionBy(*keys).orderBy(block))).drop("_last")
    joined = _join_blocks(marked, carried, [*keys, block])
    return joined.withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col(name))).drop("_first", "_carry")


def running(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    sums: dict[str, Column] | None = None,
    maxes: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running sums (NULL counts 0) and running maxima, this row included, per key in ``order``."""
    sums, maxes = sums or {}, maxes or {}
    df = df.select("*", *[F.coalesce(c, F.lit(0)).alias(f"_in_{n}") for n, c in sums.items()], *[c.alias(f"_in_{n}") for n, c in maxes.items()])
    inside = W.partitionBy(*keys, block).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    how = {**{n: F.sum for n in sums}, **{n: F.max for n in maxes}}
    totals = df.groupBy(*keys, block).agg(*[agg(f"_in_{n}").alias(f"_t_{n}") for n, agg in how.items()])
    carried = totals.select(*keys, block, *[agg(f"_t_{n}").over(before).alias(f"_c_{n}") for n, agg in how.items()])
    local = df.select("*", *[agg(f"_in_{n}").over(inside).alias(f"_l_{n}") for n, agg in how.items()])
    joined = _join_blocks(local, carried, [*keys, block])
    out = [F.col(c) for c in df.columns if not c.startswith("_in_")]
    out += [(F.col(f"_l_{n}") + F.coalesce(f"_c_{n}", F.lit(0))).alias(n) for n in sums]
    out += [F.greatest(f"_l_{n}", f"_c_{n}").alias(n) for n in maxes]
    return joined.select(*out)


def _join_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join rows to the one row of their block. The rows already sit where their window put them."""
    return rows.join(blocks, list(keys))


def salted_join(many: DataFrame, one: DataFrame, keys: Sequence[str], salt: Column, how: str = "left", salts: int = 32) -> DataFrame:
    """Join a large side, possibly with hot keys, to a side with at most one row per key.

    ``salt`` is any well-spread column of the large side. The small rows are copied once per salt value,
    so the rows of a hot key meet their partner in ``salts`` tasks instead of one. The copies are never
    broadcast: Spark judges the small table by its size before they are made, and they go through the driver.
    """
    left = many.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def sized_join(many: DataFrame, one: DataFrame, keys: Sequence[str], rows: str, salt: Column, how: str = "left", most: int = 200_000, each: int = 100_000) -> DataFrame:
    """``checked_join`` to a side that knows in ``rows`` how many rows of the large side a key has.

    Above ``most`` keys, only those with more than ``each`` rows are salted, one value for every ``each`` rows; the others are copied once.
    ``one`` is used several times, so hand in a table that is already written.
    """
    if one.limit(most + 1).count() <= most:
        return many.join(F.broadcast(one), list(keys), how)
    salts = F.greatest(F.ceil(F.col(rows) / each), F.lit(1))
    hot = one.where(F.col(rows) > each).select(*keys, salts.alias("_salts"))
    found = hot.limit(most + 1).count()
    if not found:
        return many.join(one.hint("merge"), list(keys), how)
    if found > most:
        return salted_join(many, one, keys, salt, how)
    left = many.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.pmod(F.xxhash64(salt), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1)))
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def checked_join(many: DataFrame, one: DataFrame, keys: Sequence[str], salt: Column, how: str = "left", most: int = 200_000) -> DataFrame:
    """Broadcast the small side only after counting it; above ``most`` rows, use a salted join.

    ``one`` is used twice, so hand in a table that is already written.
    """
    if one.limit(most + 1).count() <= most:
        return many.join(F.broadcast(one), list(keys), how)
    return salted_join(many, one, keys, salt, how)
