"""Compress a table of outputs: one narrow pass per row, no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions import jsonview
from logsift.functions import text as T
from logsift.functions.payload import digest
from logsift.functions.text import let
from logsift.options import DEFAULTS, Options
from logsift.plans.filters import BUILTIN_FILTERS, Filter, apply_filter, filter_name
from logsift.plans.rules import BUILTIN_RULES, Rule, apply_rules, state_struct

FOOTER_TAG = "sifted"
RECALL_HINT = "lg recall"
HANDLE_LENGTH = 24  # 96 bits: no two of many billions of outputs share a handle


def compress_lines(
    outputs: DataFrame,
    lines: str,
    command: str,
    opts: Options = DEFAULTS,
    rules: Sequence[Rule] = BUILTIN_RULES,
    filters: Sequence[Filter] = BUILTIN_FILTERS,
    state: str = "_state",
) -> DataFrame:
    """Add ``state``: ``struct<items, names>`` of the lines after their command's filter and rules."""
    none = "CAST(array() AS ARRAY<STRING>)"

    def filtered(before: str, name: str) -> str:
        def named(after: str) -> str:
            return state_struct(after, f"CASE WHEN {after} != {before} THEN array({name}) ELSE {none} END")

        return let(apply_filter(before, name, opts, filters), named)

    def start(before: str) -> str:
        return let(
            filter_name(command, filters),
            lambda name: f"CASE WHEN {name} IS NULL THEN {state_struct(before, none)} ELSE {filtered(before, name)} END",
        )

    return apply_rules(outputs.withColumn(state, F.expr(let(lines, start))), command, rules, opts, state)


def compress(
    outputs: DataFrame,
    opts: Options = DEFAULTS,
    rules: Sequence[Rule] = BUILTIN_RULES,
    filters: Sequence[Filter] = BUILTIN_FILTERS,
    json: bool = True,
    id_column: str = "id",
) -> DataFrame:
    """Add ``body, raw_tokens, comp_tokens, saved, pct, label, passthrough, handle`` to ``outputs``.

    Needs ``command`` and ``raw``. An output that is small, unchanged or saves too little keeps its raw
    text (label ``passthrough``, no handle). ``json=False`` skips the JSON view, and with it the only
    Python step, for a corpus known to hold none.
    """
    raw, command = "coalesce(raw, '')", "coalesce(command, '')"
    view, js, work = T.strip_bom(raw), "CAST(NULL AS STRING)", outputs
    if json:
        shorter = f"_js != {T.strip(view)} AND length(_js) < length({view})"
        work = work.withColumn("_js", jsonview.json_view(F.expr(view), opts))
        work = work.withColumn("_js", F.expr(f"CASE WHEN {shorter} THEN _js END"))
        js = "_js"
    # The JSON view excludes all line work, so those rows get no lines.
    lines = T.split_lines(f"CASE WHEN {js} IS NULL THEN {view} END")
    work = compress_lines(work, lines, command, opts, rules, filters)

    def judged(done: str, before: str, after: str) -> str:
        through = (
            f"{before} < {opts.min_tokens} OR {done} = {raw} OR ({before} - {after}) / nullif({before}, 0) < {opts.min_saving}D"
        )
        return let(
            f"coalesce({through}, false)",
            lambda t: f"""named_struct(
                'body', CASE WHEN {t} THEN {raw} ELSE {done} END,
                'raw_tokens', {before},
                'comp_tokens', CASE WHEN {t} THEN {before} ELSE {after} END,
                'saved', CASE WHEN {t} THEN 0L ELSE {before} - {after} END,
                'pct', CASE WHEN {t} OR {before} = 0 THEN 0.0D ELSE ({before} - {after}) / {before} * 100 END,
                'label', CASE WHEN {t} THEN 'passthrough' WHEN {js} IS NOT NULL THEN 'json'
                              WHEN size(_state.names) = 0 THEN 'none' ELSE array_join(_state.names, '+') END,
                'passthrough', {t})""",
        )

    body = f"coalesce({js}, {T.join_lines('_state.items')})"
    result = let(body, lambda d: let(T.tokens(raw), lambda b: let(T.tokens(d), lambda a: judged(d, b, a))))
    # A generator, not an alias: a later filter on a result column would otherwise be pushed below this
    # projection together with a second copy of the whole chain.
    work = work.select(*outputs.columns, F.expr(f"inline(array({result}))"))
    name = digest(F.col(id_column) if id_column in outputs.columns else F.lit(""), F.expr(raw))
    return work.withColumn("handle", F.when(~F.col("passthrough"), F.left(name, F.lit(HANDLE_LENGTH))))


def footer(results: DataFrame) -> Column:
    """The one-line note under a compressed body; also what a passthrough would say."""
    recall = F.when(
        results["handle"].isNotNull(), F.concat(F.lit(f" · full: {RECALL_HINT} "), results["handle"])
    ).otherwise("")
    note = F.concat(
        F.lit(f"⟨{FOOTER_TAG} "),
        results["label"],
        F.lit(": "),
        results["raw_tokens"].cast("string"),
        F.lit("→"),
        results["comp_tokens"].cast("string"),
        F.lit(" tok, saved "),
        F.bround(results["pct"], 0).cast("bigint").cast("string"),
        F.lit("%"),
        recall,
        F.lit("⟩"),
    )
    return F.when(
        results["passthrough"],
        F.concat(F.lit(f"⟨{FOOTER_TAG}: passthrough ("), results["raw_tokens"].cast("string"), F.lit(" tok)⟩")),
    ).otherwise(note)


def render(results: DataFrame, with_footer: bool = True) -> Column:
    """What is shown in place of the output: the body, and under a compressed one the footer."""
    if not with_footer:
        return results["body"]
    return F.when(results["passthrough"], results["body"]).otherwise(
        F.concat(results["body"], F.lit("\n"), footer(results))
    )
