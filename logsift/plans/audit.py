"""Where agent transcripts say the tokens went.

The steps: ``entries`` types every line of a recognised file, ``session_parts`` adds its requests up per
session, ``tool_calls`` and ``tool_results`` list its tool use, and the reports are small aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsift.functions.labels import canonical, namespace
from logsift.functions.text import fn, lit
from logsift.operators.ordered import checked_join, previous_row
from logsift.scratch import saved

# The runtimes, the line types that give each away, and the counters they report.
CLAUDE, CODEX, GEMINI = "claude", "codex", "gemini"
CODEX_TYPES = ["session_meta", "response_item", "event_msg", "turn_context"]
CLAUDE_TYPES = ["assistant", "user", "system", "attachment"]
TOKEN_KEYS = ["input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"]
CODEX_CALLS = ["function_call", "custom_tool_call"]
CODEX_OUTPUTS = ["function_call_output", "custom_tool_call_output"]
CODEX_OUTPUT_LABEL = "codex tool output"

_ENTRY = """
    type string, sessionId string, uuid string, timestamp string, isSidechain boolean, attributionMcpServer string,
    message struct<
        usage struct<input_tokens double, output_tokens double, cache_creation_input_tokens double, cache_read_input_tokens double>,
        content variant>,
    toolUseResult variant,
    payload struct<
        type string, name string, tool_name string, output variant,
        info struct<last_token_usage struct<
            input_tokens double, cached_input_tokens double, output_tokens double, reasoning_output_tokens double>>>,
    tool_calls variant
"""


def objects(lines: DataFrame) -> DataFrame:
    """Lines that hold one JSON object."""
    return lines.filter(F.json_object_keys("line").isNotNull())


def _line_vendor(kind: Column, keys: Column) -> Column:
    has = lambda key: F.array_contains(keys, key)
    return (
        F.when(kind.isin(CODEX_TYPES), CODEX)
        .when(has("step_index") & has("created_at"), GEMINI)
        .when(kind.isin(CLAUDE_TYPES) & (has("sessionId") | has("message")), CLAUDE)
    )


def read_files(lines: DataFrame) -> DataFrame:
    """``path, runtime, bytes`` of the files that gave lines.

    The first recognisable object of a file names its runtime, however late it comes; a file that is not recognised has none. ``bytes``
    counts the end of every line, so of a file read to its end it is the file's size, or one more if the last line has no end. One value
    per file and task is kept before the shuffle.
    """
    keyed = lines.select("path", "block", "pos", "line", F.json_object_keys("line").alias("_keys"), F.get_json_object("line", "$.type").alias("_type"))
    named = F.when(F.col("_keys").isNotNull(), _line_vendor(F.col("_type"), F.col("_keys")))
    seen = keyed.select("path", "block", "pos", named.alias("vendor"), (F.octet_length("line") + 1).alias("bytes"))
    place = F.when(F.col("vendor").isNotNull(), F.struct("block", "pos"))
    return seen.groupBy("path").agg(F.min_by("vendor", place).alias("runtime"), F.sum("bytes").alias("bytes"))


def vendors(lines: DataFrame) -> DataFrame:
    """``path, runtime`` of the files that gave lines (:func:`read_files`)."""
    return read_files(lines).select("path", "runtime")


def file_states(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """``path, runtime, state``: every file is ``read``, ``unrecognised`` or ``unreadable``.

    ``listed`` (path, size) adds files that gave no line. A file that gave fewer bytes than it has is unreadable: a damaged file is left
    off without an error where it breaks. Its lines up to there stay in the reports.
    """
    known = files if "bytes" in files.columns else files.withColumn("bytes", F.lit(None).cast("bigint"))
    known = known.withColumn("_read", F.lit(True))
    known = known.withColumn("size", F.lit(None).cast("bigint")) if listed is None else listed.select("path", "size").join(known, "path", "left")
    short = F.when(F.col("_read").isNull(), F.col("size") > 0).otherwise(F.col("bytes") < F.col("size"))
    state = F.when(F.coalesce(short, F.lit(False)), "unreadable").when(F.col("runtime").isNull(), "unrecognised").otherwise("read")
    return known.select("path", "runtime", state.alias("state"))


def file_quality(files: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """How many files were read, unrecognised and unreadable (:func:`file_states`)."""
    count = lambda state: F.count_if(F.col("state") == state)
    return file_states(files, listed).agg(
        count("read").alias("files"), count("unrecognised").alias("unrecognised_files"), count("unreadable").alias("unreadable_files")
    )


def entries(lines: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Typed objects of recognised files. The file's runtime holds for all its lines.

    The table of files is worked out once and written; it has one row per file.
    """
    files = saved(vendors(lines), "files") if files is None else files
    typed = objects(lines).withColumn("e", F.from_json("line", _ENTRY))
    named = checked_join(typed, files, ["path"], F.col("pos"))
    return named.filter(F.col("runtime").isNotNull()).select("runtime", "path", "block", "pos", "e")


def _int(c: Column) -> Column:
    return F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))


def _text(c: Column, default: str = "") -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(default)).otherwise(c)


def _billing(ents: DataFrame) -> DataFrame:
    """One row per billed request, and one per step of a runtime without counters."""
    used, last = F.col("e.message.usage"), F.col("e.payload.info.last_token_usage")
    prompt, cached = _int(last["input_tokens"]), _int(last["cached_input_tokens"])
    output = _int(last["output_tokens"])
    claude = F.struct(*[_int(used[k]).alias(k) for k in TOKEN_KEYS])
    codex = F.struct(
        F.greatest(prompt - cached, F.lit(0)).alias(TOKEN_KEYS[0]),
        (output + _int(last["reasoning_output_tokens"])).alias(TOKEN_KEYS[1]),
        F.lit(0).cast("bigint").alias(TOKEN_KEYS[2]),
        cached.alias(TOKEN_KEYS[3]),
    )
    is_claude = (F.col("runtime") == CLAUDE) & (F.col("e.type") == "assistant")
    is_codex = (F.col("runtime") == CODEX) & (F.col("e.payload.type") == "token_count") & ((prompt != 0) | (output != 0))
    any_used = F.lit(False)
    for k in TOKEN_KEYS:
        any_used = any_used | (_int(used[k]) != 0)
    session = F.when(_text(F.col("e.sessionId")) != "", F.col("e.sessionId")).otherwise(F.left(_text(F.col("e.uuid"), "unknown"), F.lit(8)))
    u = F.col("u")
    rows = ents.select(
        "runtime", "path", "block", "pos",
        (F.col("runtime") == GEMINI).alias("is_step"),
        F.when(is_claude & any_used, claude).when(is_codex, codex).alias("u"),
        F.when(F.col("runtime") == CLAUDE, session).otherwise(F.col("path")).alias("session"),
        F.coalesce(is_claude & F.col("e.isSidechain"), F.lit(False)).alias("is_sidechain"),
        prompt.alias("_prompt"),
        F.left(_text(F.col("e.timestamp")), F.lit(10)).alias("date"),
    ).filter(F.col("is_step") | u.isNotNull())
    whole = u[TOKEN_KEYS[0]] + u[TOKEN_KEYS[2]] + u[TOKEN_KEYS[3]]
    return rows.select(
        "runtime", "path", "block", "pos", "is_step", "session", "is_sidechain",
        *[u[k].alias(k) for k in TOKEN_KEYS],
        F.when(F.col("runtime") == CODEX, F.col("_prompt")).otherwise(whole).alias("prompt_total"),
        "date",
    )


def usage(ents: DataFrame) -> DataFrame:
    """One row per billed request: four counters and the size of the whole prompt."""
    return _billing(ents).filter(~F.col("is_step")).drop("is_step")


def session_parts(ents: DataFrame) -> DataFrame:
    """One row per session: own requests, subagent requests and steps. All reports below add these up.

    The transcripts are read once for all of them; the sums leave every task as one row per session, so a
    session with most of the requests is no skew. Subagent requests have a floor of their own and are not
    part of the session's.
    """
    rows, side, step = _billing(ents), F.col("is_sidechain"), F.col("is_step")
    own = ~side & ~step
    prompt = F.when(own, F.col("prompt_total"))
    dated = F.when(own & (F.col("date") != ""), F.struct("path", "block", "pos"))
    total = lambda when, k: F.coalesce(F.sum(F.when(when, F.col(k))), F.lit(0))
    return rows.groupBy("runtime", "session").agg(
        F.count_if(own).alias("requests"),
        F.count_if(side).alias("subagent_requests"),
        F.count_if(step).alias("steps"),
        F.coalesce(F.max_by("date", dated), F.lit("")).alias("date"),
        F.coalesce(F.min(F.when(prompt > 0, prompt)), F.lit(0)).alias("floor"),
        F.coalesce(F.max(prompt), F.lit(0)).alias("peak"),
        *[total(own, k).alias(k) for k in TOKEN_KEYS],
        *[total(side, k).alias(f"subagent_{k}") for k in TOKEN_KEYS],
    )


_LISTED = "coalesce(try_variant_get({0}, '$', 'array<variant>'), CAST(array() AS ARRAY<VARIANT>))"


def _field(block: str, *names: str) -> str:
    """First of some text members that is there and not empty."""
    return f"coalesce({', '.join(f"nullif(try_variant_get({block}, '$.{n}', 'string'), '')" for n in names)}, '')"


def _calls() -> str:
    """``array<struct<i, tool, id>>``: the tool calls of one entry, those of subagents too."""

    def called(blocks: str, names: tuple[str, ...], wanted: str) -> str:
        one = f"named_struct('i', i, 'tool', coalesce(nullif({_field('b', *names)}, ''), '?'), 'id', {_field('b', 'id')})"
        return f"filter(transform({blocks}, (b, i) -> CASE WHEN {wanted} THEN {one} END), c -> c IS NOT NULL)"

    claude = called(_LISTED.format("e.message.content"), ("name",), "try_variant_get(b, '$.type', 'string') = 'tool_use'")
    gemini = called(_LISTED.format("e.tool_calls"), ("tool_name", "name"), "schema_of_variant(b) LIKE 'OBJECT%'")
    codex = "array(named_struct('i', 0, 'tool', coalesce(nullif(e.payload.name, ''), nullif(e.payload.tool_name, ''), '?'), 'id', ''))"
    kinds = ", ".join(f"'{k}'" for k in CODEX_CALLS)
    return f"""CASE WHEN runtime = '{CLAUDE}' AND e.type = 'assistant' THEN {claude}
        WHEN runtime = '{CODEX}' AND e.payload.type IN ({kinds}) THEN {codex}
        WHEN runtime = '{GEMINI}' THEN {gemini} END"""


def tool_calls(ents: DataFrame) -> DataFrame:
    """``runtime, path, block, pos, i, tool, id``: one row per tool call."""
    return ents.select("runtime", "path", "block", "pos", F.expr(f"inline({_calls()})"))


def _size(value: str) -> str:
    """Characters of a string; of any other value, those of its JSON text with a space after , and :."""
    compact = f"to_json({value})"
    bare = f"regexp_replace({compact}, {lit(r'"(?:[^"\\]|\\.)*"')}, '')"
    return (
        f"CASE WHEN {value} IS NULL OR schema_of_variant({value}) = 'VOID' THEN 0L "
        f"WHEN schema_of_variant({value}) = 'STRING' THEN bigint(length(variant_get({value}, '$', 'string'))) "
        f"ELSE bigint(length({compact}) + length({bare}) - length(translate({bare}, ',:', ''))) END"
    )


def tool_results(ents: DataFrame) -> DataFrame:
    """``tool, size``: sizes of results, each under the call it answers.

    A result takes the name of the call with its id, and the first result uses the id up. So a result
    counts when the row before it with the same id is a call.
    """
    first = f"get(filter({_LISTED.format('e.message.content')}, b -> try_variant_get(b, '$.type', 'string') = 'tool_result'), 0)"
    answer = (
        f"array(named_struct('i', 0, 'tool', CAST(NULL AS STRING), 'id', {_field(first, 'tool_use_id')}, "
        f"'size', {_size('e.toolUseResult')}))"
    )
    asked = f"transform({_calls()}, c -> named_struct('i', c.i, 'tool', c.tool, 'id', c.id, 'size', CAST(NULL AS BIGINT)))"
    both = ents.filter(F.col("runtime") == CLAUDE).select(
        "path", "block", "pos", F.expr(f"inline(CASE WHEN e.type = 'user' THEN {answer} ELSE {asked} END)")
    )
    both = both.filter(F.col("id") != "").withColumn("_stretch", F.struct("path", "block"))
    linked = previous_row(both, ["id"], "_stretch", ["path", "block", "pos", "i"], ["tool"], "_call")
    claude = linked.filter(F.col("tool").isNull() & F.col("_call.tool").isNotNull()).select(F.col("_call.tool").alias("tool"), "size")
    codex = ents.filter(
        (F.col("runtime") == CODEX) & F.col("e.payload.type").isin(CODEX_OUTPUTS)
        & (F.expr("schema_of_variant(e.payload.output)") == "STRING")
    ).select(F.lit(CODEX_OUTPUT_LABEL).alias("tool"), F.expr(_size("e.payload.output")).alias("size"))
    return claude.filter(F.col("size") > 0).unionByName(codex)


def sessions(parts: DataFrame) -> DataFrame:
    """Requests, date, floor and peak per session that has requests of its own."""
    own = parts.filter(F.col("requests") > 0)
    return own.select("runtime", "session", "requests", "date", "floor", "peak", *TOKEN_KEYS)


def _median_floor(rollup: DataFrame, *by: str) -> DataFrame:
    """Whole part of the median of the positive floors.

    Floors are counted first, so the median works on distinct prompt sizes, which the context length of a
    model bounds, and not on sessions.
    """
    counted = rollup.filter(F.col("floor") > 0).groupBy(*by, "floor").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(*by).agg(F.expr("CAST(percentile(floor, 0.5D, n) AS BIGINT)").alias("floor"))


def _all_tokens(k: str) -> Column:
    return F.sum(F.col(k) + F.col(f"subagent_{k}"))


def runtimes(parts: DataFrame, files: DataFrame) -> DataFrame:
    """One row per runtime found. Tokens of a runtime without counters are unknown, not 0.

    The joined frames have one row per runtime.
    """
    sums = parts.groupBy("runtime").agg(
        F.sum(F.col("requests") + F.col("subagent_requests")).alias("requests"),
        F.sum("steps").alias("steps"),
        *[_all_tokens(k).alias(k) for k in TOKEN_KEYS],
    )
    counts = files.filter("runtime IS NOT NULL").groupBy("runtime").agg(F.count(F.lit(1)).alias("files"))
    rows = counts.join(sums, "runtime", "left").join(_median_floor(parts, "runtime"), "runtime", "left")
    known = F.col("runtime") != GEMINI
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    only = lambda c: F.when(known, c)
    return rows.select(
        "runtime",
        "files",
        n("requests").alias("requests"),
        n("steps").alias("steps"),
        known.alias("tokens_available"),
        *[only(n(k)).alias(k) for k in TOKEN_KEYS],
        only(n("floor")).alias("session_floor"),
        only(n("floor") * n("requests")).alias("floor_cost"),
        only(n(TOKEN_KEYS[3])).alias("context_read"),
    )


def fixed_cost(parts: DataFrame) -> DataFrame:
    """Tokens spent on re-reading the floor: summed per runtime where known, else median times requests."""
    every = F.sum(F.col("requests") + F.col("subagent_requests")).alias("requests")
    sums = parts.filter(F.col("runtime") != GEMINI).groupBy("runtime").agg(every)
    known = sums.join(_median_floor(parts, "runtime"), "runtime", "left").select(
        "requests", (F.coalesce("floor", F.lit(0)) * F.col("requests")).alias("cost"), F.lit(None).cast("bigint").alias("floor")
    )
    blended = _median_floor(parts).select(F.lit(None).cast("bigint").alias("requests"), F.lit(None).cast("bigint").alias("cost"), "floor")
    one = known.unionByName(blended).agg(F.sum("requests").alias("requests"), F.sum("cost").alias("cost"), F.max("floor").alias("floor"))
    floor, requests = F.coalesce("floor", F.lit(0)), F.coalesce("requests", F.lit(0))
    return one.select(
        floor.alias("session_floor"), requests.alias("requests"), F.coalesce(F.col("cost"), floor * requests).alias("floor_cost")
    )


def totals(parts: DataFrame) -> DataFrame:
    """Sessions, requests and tokens, and the part of subagents."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.agg(
        F.count_if(F.col("requests") > 0).alias("sessions"),
        zero(F.sum(F.col("requests") + F.col("subagent_requests"))).alias("requests"),
        zero(F.sum("subagent_requests")).alias("subagent_requests"),
        *[zero(_all_tokens(k)).alias(k) for k in TOKEN_KEYS],
        *[zero(F.sum(f"subagent_{k}")).alias(f"subagent_{k}") for k in TOKEN_KEYS],
    )


def subagent_share(parts: DataFrame) -> DataFrame:
    """Share of all context read again that subagents read, in percent."""
    read, side = F.col(TOKEN_KEYS[3]), F.col(f"subagent_{TOKEN_KEYS[3]}")
    sums = parts.agg(F.coalesce(F.sum(read + side), F.lit(0)).alias("context_read"), F.coalesce(F.sum(side), F.lit(0)).alias("subagent_context_read"))
    share = F.when(F.col("context_read") > 0, F.col("subagent_context_read") * 100.0 / F.col("context_read")).otherwise(0.0)
    return sums.withColumn("subagent_share_pct", F.bround(share, 1))


def calls_by_tool(calls: DataFrame) -> DataFrame:
    """Calls per tool over all runtimes (``runtime`` NULL) and per runtime."""
    runtime, tool = F.col("runtime"), F.col("tool")
    return calls.groupingSets([[runtime, tool], [tool]], runtime, tool).agg(F.count(F.lit(1)).alias("calls"))


def result_sizes(results: DataFrame) -> DataFrame:
    return results.groupBy("tool").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("results"))


def top(report: DataFrame, by: str, limit: int = 6) -> DataFrame:
    return report.orderBy(F.desc(by), "tool").limit(limit)


def server_calls(ents: DataFrame) -> DataFrame:
    """Calls per server under its most-called spelling.

    A call can carry an attribution and a name with a namespace; both are counted, and also kept apart.
    """
    spoken = F.expr(f"""concat(
        CASE WHEN runtime = '{CLAUDE}' AND e.type = 'assistant' AND e.attributionMcpServer != ''
            THEN array(named_struct('rank', 0, 'i', 0, 'name', e.attributionMcpServer))
            ELSE CAST(array() AS ARRAY<STRUCT<rank INT, i INT, name STRING>>) END,
        coalesce(transform({_calls()}, c -> named_struct('rank', 1, 'i', c.i, 'name', c.tool)), array()))""")
    rows = ents.select("path", "block", "pos", F.explode(spoken).alias("s")).select(
        "path", "block", "pos", "s.rank", "s.i", F.when(F.col("s.rank") == 0, F.col("s.name")).otherwise(namespace(F.col("s.name"))).alias("name")
    )
    spellings = rows.filter(F.col("name") != "").groupBy("name").agg(
        F.count_if(F.col("rank") == 0).alias("attributed"),
        F.count_if(F.col("rank") == 1).alias("namespaced"),
        F.min(F.struct("rank", "path", "block", "pos", "i")).alias("seen"),
    )
    calls = F.col("attributed") + F.col("namespaced")
    return spellings.groupBy(canonical(F.col("name")).alias("server")).agg(
        F.max_by("name", F.struct(calls, "seen")).alias("label"),
        F.sum(calls).alias("calls"), F.sum("attributed").alias("attributed"), F.sum("namespaced").alias("namespaced"),
    )


def _pieces(name: str) -> str:
    """All substrings of a name, the empty one too."""
    ends = fn(lambda s: f"transform(sequence(1, length({name}) - {s} + 1), {fn(lambda n: f'substring({name}, {s}, {n})')})")
    return f"array_distinct(concat(array(''), CASE WHEN length({name}) = 0 THEN array() ELSE flatten(transform(sequence(1, length({name})), {ends})) END))"


def idle_surface(configured: DataFrame, used: DataFrame) -> DataFrame:
    """Configured names that match no called server.

    A match is the part before ``@`` being equal to, inside, or around an observed name. Names are cut
    into their substrings and joined on equality, so the two lists never meet pair by pair.
    """
    stem = F.lower(F.trim(F.split("name", "@", 2)[0]))
    asked = configured.withColumn("stem", stem).filter(F.col("stem") != "")
    seen = used.select(F.lower(F.trim("label")).alias("seen")).distinct()
    inside = seen.select(F.explode(F.expr(_pieces("replace(seen, '-', '_')"))).alias("stem")).distinct()
    same = seen.select(F.col("seen").alias("stem"))
    around = asked.select("name", "stem", F.explode(F.expr(_pieces("stem"))).alias("seen")).join(seen, "seen", "left_semi")
    matched = around.select("name").distinct()
    left = asked.join(inside.unionByName(same).distinct(), "stem", "left_anti")
    return left.join(matched, "name", "left_anti").select("name", "source")


def server_report(configured: DataFrame, used: DataFrame) -> DataFrame:
    """Called servers with where they are configured, and the idle ones with 0 calls.

    Both inputs are reports of one row per name; they are used several times, so hand in written tables.
    """
    called = used.select(F.col("label").alias("name"), "calls").join(configured, "name", "left")
    called = called.select("name", "calls", F.coalesce("source", F.lit("not in config")).alias("source"), F.lit(False).alias("idle"))
    idle = idle_surface(configured, used).select("name", F.lit(0).cast("bigint").alias("calls"), "source", F.lit(True).alias("idle"))
    return called.unionByName(idle)
