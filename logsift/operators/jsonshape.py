"""What a column of JSON documents looks like, and typed cuts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.jsonview import json_view, looks_like_json
from logsift.functions.text import fn, let, tokens
from logsift.options import DEFAULTS, Options


def _kind(value: str) -> str:
    def named(schema: str) -> str:
        return (
            f"CASE WHEN {schema} LIKE 'OBJECT%' THEN 'object' WHEN {schema} LIKE 'ARRAY%' THEN 'array' "
            f"WHEN {schema} = 'STRING' THEN 'string' WHEN {schema} = 'BOOLEAN' THEN 'boolean' "
            f"WHEN {schema} = 'VOID' THEN 'null' ELSE 'number' END"
        )

    return let(f"schema_of_variant({value})", named)


def _node(path: str, value: str) -> str:
    return f"named_struct('path', {path}, 'kind', {_kind(value)}, 'v', {value})"


def _children(nodes: str) -> str:
    """Nodes one level down, of all containers in ``nodes``; list items share a path."""

    def of(n: str) -> str:
        member = fn(lambda e: _node(f"concat({n}.path, '.', {e}.key)", f"{e}.value"))
        item = fn(lambda x: _node(f"concat({n}.path, '[]')", x))
        return (
            f"CASE WHEN {n}.kind = 'object' THEN transform(map_entries(variant_get({n}.v, '$', 'map<string,variant>')), {member}) "
            f"WHEN {n}.kind = 'array' THEN transform(variant_get({n}.v, '$', 'array<variant>'), {item}) "
            "ELSE CAST(array() AS ARRAY<STRUCT<path STRING, kind STRING, v VARIANT>>) END"
        )

    return f"flatten(transform({nodes}, {fn(of)}))"


def json_nodes(docs: DataFrame, text: str = "raw", id_column: str = "id", opts: Options = DEFAULTS) -> DataFrame:
    """``id, path, depth, kind, size``: every node down to the depth limit; list items share a path.

    ``size`` is members of an object, items of a list, characters of a string, else NULL. A document is
    parsed once and walked level by level inside its row.
    """

    def described(depth: int, nodes: str) -> str:
        def one(n: str) -> str:
            size = (
                f"CASE {n}.kind WHEN 'object' THEN size(map_keys(variant_get({n}.v, '$', 'map<string,variant>'))) "
                f"WHEN 'array' THEN size(variant_get({n}.v, '$', 'array<variant>')) "
                f"WHEN 'string' THEN length(variant_get({n}.v, '$', 'string')) END"
            )
            return f"named_struct('path', {n}.path, 'depth', {depth}, 'kind', {n}.kind, 'size', bigint({size}))"

        return f"transform({nodes}, {fn(one)})"

    levels = [f"CASE WHEN _v IS NULL THEN CAST(array() AS ARRAY<STRUCT<path STRING, kind STRING, v VARIANT>>) ELSE array({_node("'$'", '_v')}) END"]
    work = docs.select(F.col(id_column).alias("id"), F.try_parse_json(text).alias("_v")).withColumn("_l0", F.expr(levels[0]))
    for depth in range(1, opts.json_max_depth + 1):
        work = work.withColumn(f"_l{depth}", F.expr(_children(f"_l{depth - 1}")))
    found = ", ".join(described(d, f"_l{d}") for d in range(opts.json_max_depth + 1))
    return work.select("id", F.expr(f"inline(concat({found}))"))


def json_shape(nodes: DataFrame) -> DataFrame:
    """Nodes per path and kind, and the largest of them."""
    return nodes.groupBy("path", "depth", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.max("size").alias("largest"))


def json_hidden(nodes: DataFrame, opts: Options = DEFAULTS) -> DataFrame:
    """Per path, what the view would hide: list items, string characters, containers at the depth limit."""
    beyond = lambda kind, most: F.coalesce(F.sum(F.when((F.col("kind") == kind) & (F.col("size") > most) & (F.col("depth") < opts.json_max_depth), F.col("size") - most)), F.lit(0))
    elided = F.count_if(F.col("kind").isin("object", "array") & (F.col("depth") == opts.json_max_depth))
    cut = nodes.groupBy("path").agg(
        beyond("array", opts.json_max_array).alias("items_hidden"),
        beyond("string", opts.json_max_str).alias("chars_hidden"),
        elided.alias("containers_elided"),
    )
    return cut.filter("items_hidden + chars_hidden + containers_elided > 0")


def cut_array(items: Column, opts: Options = DEFAULTS) -> Column:
    """Typed counterpart of the view for a list column: the first items and how many are hidden."""
    return F.struct(
        F.slice(items, 1, opts.json_max_array).alias("items"),
        F.greatest(F.size(items) - opts.json_max_array, F.lit(0)).alias("hidden"),
        F.size(items).alias("total"),
    )


def cut_string(text: Column, opts: Options = DEFAULTS) -> Column:
    n = opts.json_max_str
    marker = F.concat(F.left(text, F.lit(n)), F.lit("… ⟨+"), (F.length(text) - n).cast("string"), F.lit(" chars⟩"))
    return F.when(F.length(text) > n, marker).otherwise(text)


def json_report(docs: DataFrame, text: str = "raw", opts: Options = DEFAULTS) -> DataFrame:
    """Tokens of each JSON document before and after the view, shown also when nothing is gained."""
    # Out of a generator, so that the filter on the view does not run the Python step twice.
    view = F.explode(F.array(json_view(F.col(text), opts))).alias("view")
    viewed = docs.filter(looks_like_json(F.col(text))).select(*[c for c in docs.columns if c.lower() != "view"], view).filter("view IS NOT NULL")
    before, after = F.expr(tokens(text)), F.expr(tokens("view"))
    return viewed.select(
        *[c for c in docs.columns if c != text],
        before.alias("tokens_before"),
        after.alias("tokens_after"),
        F.when(before > 0, F.bround((before - after) * 100 / before, 1)).otherwise(0.0).alias("saved_pct"),
    )
