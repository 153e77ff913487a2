"""Configured servers and plugins, read from configuration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def configured_servers(configs: DataFrame) -> DataFrame:
    """``name, source`` of everything configured; the first source of a name wins.

    ``configs``: ``path, kind, text`` with kind ``main`` (servers, and servers per project), ``settings``
    (enabled plugins: an object of flags or a list) or ``extra`` (servers). A document that is not a JSON
    object names nothing.
    """
    docs = configs.withColumn("v", F.try_parse_json("text"))
    spark = configs.sparkSession

    def members(rows: DataFrame, column: str) -> DataFrame:
        """``key, value`` of the members of an object, ``pos, value`` of a list."""
        return rows.lateralJoin(spark.tvf.variant_explode_outer(F.col(column).outer()))

    def named(rows: DataFrame, rank: int) -> DataFrame:
        return rows.select("name", "source", F.lit(rank).alias("rank"))

    def servers(kind: str, rank: int) -> DataFrame:
        rows = docs.filter(F.col("kind") == kind).select("path", F.try_variant_get("v", "$.mcpServers", "variant").alias("m"))
        return named(members(rows, "m").filter("key IS NOT NULL").select(F.col("key").alias("name"), F.col("path").alias("source")), rank)

    projects = docs.filter(F.col("kind") == "main").select("path", F.try_variant_get("v", "$.projects", "variant").alias("p"))
    projects = members(projects, "p").filter("key IS NOT NULL").select(
        "path", F.col("key").alias("project"), F.try_variant_get("value", "$.mcpServers", "variant").alias("m")
    )
    per_project = members(projects, "m").filter("key IS NOT NULL").select(
        F.col("key").alias("name"), F.concat("path", F.lit(" ("), "project", F.lit(")")).alias("source")
    )
    plugins = docs.filter(F.col("kind") == "settings").select("path", F.try_variant_get("v", "$.enabledPlugins", "variant").alias("m"))
    plugins = members(plugins, "m").select("path", "pos", "key", "value")
    enabled = plugins.filter(
        F.col("key").isNotNull() & F.coalesce(F.try_variant_get("value", "$", "boolean"), F.col("value").isNotNull())
    ).select(F.col("key").alias("name"), F.concat("path", F.lit(" enabledPlugins")).alias("source"))
    listed = plugins.filter(F.col("key").isNull() & F.col("pos").isNotNull()).select(
        F.try_variant_get("value", "$", "string").alias("name"), F.concat("path", F.lit(" enabledPlugins")).alias("source")
    )
    found = servers("main", 1).unionByName(named(per_project, 2)).unionByName(named(enabled, 3)).unionByName(named(listed, 3)).unionByName(servers("extra", 4))
    # min_by keeps one row per name before the shuffle, however often a name is configured.
    return found.filter("name IS NOT NULL").groupBy("name").agg(F.min_by("source", F.struct("rank", "source")).alias("source"))
