"""The recall table: full originals of compressed outputs, with caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.payload import capped, digest, payload_bytes
from logsift.functions.times import micros
from logsift.options import DEFAULTS, Options
from logsift.scratch import saved


def store_rows(results: DataFrame, opts: Options = DEFAULTS, store_all: bool = False) -> DataFrame:
    """Rows to remember: compressed outputs (or all), the payload cut at the byte cap if one is set.

    Needs the columns of ``compress`` plus ``id, ts, cwd, exit_code``. Token counts are of the full text.
    """
    kept = results if store_all else results.filter(~F.col("passthrough"))
    return kept.select(
        F.col("id").cast("string").alias("id"),
        "ts",
        "command",
        "cwd",
        "exit_code",
        capped(F.col("raw"), opts.max_row_bytes).alias("raw"),
        "raw_tokens",
        "comp_tokens",
        F.col("label").alias("filt"),
        digest(F.col("id"), F.col("raw")).alias("name"),
        F.to_date("ts").alias("day"),
    ).withColumn("bytes", payload_bytes(F.col("raw")).cast("bigint"))


def write_store(rows: DataFrame, path: str, mode: str = "append", by_time: bool = False) -> None:
    """Write by day. Rebalancing gives every day files of a good size and splits a day that is large.

    ``by_time=True`` skips that shuffle for rows that already lie in order of time. Files are in the order of names and hold a Bloom
    filter of them, so a handle is looked for in few row groups and a whole name in next to none.
    """
    rows = rows if by_time else rows.hint("rebalance", "day")
    _laid_out(rows).mode(mode).parquet(path)


def _laid_out(rows: DataFrame) -> DataFrameWriter:
    bloom = {"parquet.bloom.filter.enabled#name": "true", "parquet.bloom.filter.expected.ndv#name": "100000"}
    return rows.sortWithinPartitions("day", "name").write.partitionBy("day").options(**bloom)


def names_path(path: str) -> str:
    return f"{path.rstrip('/')}-names"


def write_names(spark: SparkSession, path: str) -> None:
    """Write which day each name of the store at ``path`` is in, by the first two digits of the name. Reads no payload."""
    names = read_store(spark, path).select(F.left("name", F.lit(2)).alias("start"), "name", F.col("day").cast("string").alias("day"))
    names.hint("rebalance", "start").sortWithinPartitions("start", "name").write.partitionBy("start").mode("overwrite").parquet(names_path(path))


def recall_in(spark: SparkSession, path: str, handle: str) -> DataFrame:
    """``recall`` on a written store: the days come from the table of names, so that only those are read."""
    names = spark.read.schema("name string, day string, start string").parquet(names_path(path))
    days = names.filter((F.col("start") == handle[:2]) & F.col("name").startswith(handle)).select("day").distinct().collect()
    known = [r["day"] for r in days if r["day"] is not None]
    there = F.col("day").isin(known) if known else F.lit(False)
    there = there | F.col("day").isNull() if len(known) < len(days) else there
    return recall(read_store(spark, path).filter(there), handle)


def prune_store(spark: SparkSession, path: str, opts: Options) -> int:
    """Delete the oldest rows of the store at ``path`` beyond the caps on rows and on bytes; the number of rows that went.

    What stays is settled on ids, times and sizes, without a payload. Days that lose all rows are deleted as folders; of the one in which
    a cap is reached the rows that stay are written aside and then take its place. A run that was interrupted is finished by the next.
    Rows that are equal in id and name stay together.
    """
    store = read_store(spark, path)
    slim = saved(store.select("id", "ts", "name", "bytes", F.col("day").cast("string").alias("day")), "store-sizes")
    kept = cap_bytes(cap_rows(slim, opts.max_store_rows), opts.max_store_bytes)
    kept = saved(kept.select("id", "name", "day"), "store-kept")
    counts = slim.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).join(kept.groupBy(F.col("day").alias("kept_day")).agg(F.count(F.lit(1)).alias("kept")), F.col("day").eqNullSafe(F.col("kept_day")), "left")
    days = counts.select("day", "rows", F.coalesce("kept", F.lit(0)).alias("kept")).collect()  # a row for each day
    cut = [r["day"] for r in days if 0 < r["kept"] < r["rows"]]
    if cut:
        day = F.col("day").cast("string")
        of_day = day.isin([d for d in cut if d is not None]) | (day.isNull() if None in cut else F.lit(False))
        stays = kept.select("id", "name", F.col("day").alias("kept_day"))
        rows = store.filter(of_day).join(stays, [store["id"] == stays["id"], store["name"] == stays["name"], day.eqNullSafe(stays["kept_day"])], "left_semi")
        _laid_out(saved(rows, "store-day")).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in days:
        if not r["kept"]:
            folder = hadoop(f"{path.rstrip('/')}/day={'__HIVE_DEFAULT_PARTITION__' if r['day'] is None else r['day']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sum(r["rows"] - r["kept"] for r in days)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def with_handles(rows: DataFrame, name: str = "name", shortest: int = 6) -> DataFrame:
    """Add ``handle``: the shortest prefix of ``name`` (6 or more characters) no other row shares.

    Names that agree in 6 characters are neighbours in sorted order, so a row only has to differ from the
    two next to it. The groups are slices of a hash and cannot be skewed. For listings: hand in the few
    columns to show, not the payloads. Recall needs no handle column, it matches a prefix of the name.
    """
    around = W.partitionBy("_start").orderBy(name)
    lengths = F.sequence(F.lit(shortest), F.lit(64))

    def shared(other: Column) -> Column:
        same = F.filter(lengths, lambda n: F.left(other, n) == F.left(F.col(name), n))
        return F.when(other.isNull(), F.lit(shortest - 1)).otherwise(F.lit(shortest - 1) + F.size(same))

    started = rows.withColumn("_start", F.left(name, F.lit(shortest)))
    both = started.select("*", F.lag(name).over(around).alias("_before"), F.lead(name).over(around).alias("_after"))
    return both.withColumn(
        "handle", F.left(name, F.greatest(shared(F.col("_before")), shared(F.col("_after"))) + 1)
    ).drop("_start", "_before", "_after")


def recall(store: DataFrame, handle: str) -> DataFrame:
    """The row whose name starts with the handle; the filter reaches the Parquet statistics."""
    return store.filter(F.col("name").startswith(handle))


def recent(store: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows. How old they are is found on the times alone, so older days and payloads are not read."""
    newest = store.select("ts").orderBy(F.desc("ts")).limit(limit).agg(F.count("ts").alias("n"), F.min("ts").alias("since"))
    found = newest.select("n", F.date_sub(F.to_date("since"), F.lit(1)).alias("day"), micros("since").alias("since")).first()
    if limit > 0 and found["n"] == limit:
        store = store.filter(F.col("ts").cast("timestamp") >= F.timestamp_micros(F.lit(found["since"])))
        if "day" in store.columns:
            store = store.filter(F.col("day") >= F.lit(found["day"]))
    return store.orderBy(F.desc("ts"), "id").limit(limit)


def discover(store: DataFrame, limit: int = 15, among: int = 500) -> DataFrame:
    """Largest outputs among the newest ``among``."""
    return recent(store, among).orderBy(F.desc("raw_tokens"), F.desc("ts"), "id").limit(limit)


def totals(store: DataFrame) -> DataFrame:
    raw, comp = F.coalesce(F.sum("raw_tokens"), F.lit(0)), F.coalesce(F.sum("comp_tokens"), F.lit(0))
    held = store.agg(F.count(F.lit(1)).alias("outputs_held"), raw.alias("tokens_in"), comp.alias("tokens_out"))
    saved = F.col("tokens_in") - F.col("tokens_out")
    return held.select(
        "*",
        saved.alias("tokens_saved"),
        F.when(F.col("tokens_in") > 0, F.bround(saved * 100 / F.col("tokens_in"), 1)).otherwise(0.0).alias("reduction_pct"),
    )


def cap_rows(store: DataFrame, cap: int | None) -> DataFrame:
    """The newest ``cap`` rows."""
    return keep_newest(store, F.lit(1).cast("bigint"), cap)


def cap_bytes(store: DataFrame, cap: int | None) -> DataFrame:
    """The newest rows whose payloads fit ``cap`` bytes together; oldest go first."""
    size = F.col("bytes") if "bytes" in store.columns else payload_bytes(F.col("raw"))
    return keep_newest(store, size.cast("bigint"), cap)


def keep_newest(store: DataFrame, weight: Column, cap: int | None) -> DataFrame:
    """Rows whose weight, together with that of all newer rows, is at most ``cap``. Off for no cap.

    There is no window over the whole table. Weights are summed per day, and only the day in which the
    cap is reached is looked at by the second, then by the microsecond, then by slices of a hash for rows
    of one instant. Each look brings one boundary value back; the windows see at most a day's seconds, a
    second's microseconds or 4,096 slices. Rows of one instant are ordered by the MD5 of their id. Rows
    without a time are older than all others.
    """
    if not cap or cap <= 0:
        return store
    at = micros("ts")
    tie = F.md5(F.col("id").cast("string"))
    timeless = F.lit(-(1 << 62))
    levels = [
        F.coalesce(F.floor(at / 86_400_000_000), timeless),
        F.coalesce(F.pmod(F.floor(at / 1_000_000), F.lit(86_400)), timeless),
        F.coalesce(F.pmod(at, F.lit(1_000_000)), timeless),
        F.conv(F.left(tie, F.lit(3)), 16, 10).cast("bigint"),
    ]
    newer, here, budget = F.lit(False), F.lit(True), cap
    weighed = store.select("id", "ts", F.coalesce(weight, F.lit(0).cast("bigint")).alias("_w"))
    for level in levels:
        sums = weighed.filter(here).groupBy(level.alias("level")).agg(F.sum("_w").alias("w"))
        # One row per bucket of this level: small by construction.
        upto = sums.withColumn("upto", F.sum("w").over(W.orderBy(F.desc("level"))))
        edge = upto.filter(F.col("upto") > budget).orderBy(F.desc("level")).first()
        if edge is None:
            return store.filter(newer | here)
        newer = newer | (here & (level > edge.level))
        here = here & (level == edge.level)
        budget -= edge.upto - edge.w
    inside = store.filter(here).withColumn("_w", F.coalesce(weight, F.lit(0).cast("bigint")))
    newest_first = W.orderBy(F.desc("_tie"), F.desc("id"))
    inside = inside.withColumn("_tie", tie).withColumn("_upto", F.sum("_w").over(newest_first))
    return store.filter(newer).unionByName(inside.filter(F.col("_upto") <= budget).drop("_w", "_tie", "_upto"))
