"""Names: runtimes, servers, elapsed phrases and range keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logsift.functions.text import SPACE, UNICODE
from logsift.functions.times import micros

# The runtimes that are counted, and the spellings that stand for them.
CLIENTS = ["codex", "claude", "gemini", "local"]
CLIENT_ALIASES = {
    "codex": "codex",
    "claude": "claude",
    "claude-code": "claude",
    "gemini": "gemini",
    "antigravity": "gemini",
    "gemini-antigravity": "gemini",
    "local": "local",
    "localagent": "local",
    "lmstudio": "local",
    "unknown": "unknown",
}
# Environment variables that give a runtime away, in order of precedence.
CLIENT_MARKERS = [
    ("codex", ["CODEX_THREAD_ID", "CODEX_HOME"]),
    ("claude", ["CLAUDECODE", "CLAUDE_CODE", "CLAUDE_CODE_ENTRYPOINT"]),
    ("local", ["LOCALAGENT", "LOCAL_AGENT"]),
]


def strip(name: Column) -> Column:
    return F.regexp_replace(name, f"{UNICODE}^{SPACE}+|{SPACE}+$", "")


def client_label(name: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in CLIENT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, F.lower(strip(name))), F.lit("unknown"))


def client_from_markers(explicit: Column, env: Column, named_variable: str = "LOGSIFT_CLIENT") -> Column:
    """Explicit name, then the named variable, then runtime markers in ``env`` (a map column)."""

    def filled(key):
        return F.coalesce(F.try_element_at(env, F.lit(key)), F.lit("")) != ""

    label = F.when(F.coalesce(explicit, F.lit("")) != "", client_label(explicit))
    label = label.when(filled(named_variable), client_label(F.try_element_at(env, F.lit(named_variable))))
    for client, variables in CLIENT_MARKERS:
        found = filled(variables[0])
        for variable in variables[1:]:
            found = found | filled(variable)
        label = label.when(found, F.lit(client))
    return label.otherwise("unknown")


def namespace(tool: Column) -> Column:
    """Server of a ``mcp__server__tool`` name, NULL for a built-in tool."""
    parts = F.split(tool, "__", -1)
    return F.when(tool.startswith("mcp__") & (F.size(parts) > 2), F.get(parts, F.lit(1)))


def canonical(name: Column) -> Column:
    folded = F.regexp_replace(F.lower(strip(name)), r"[^\p{L}\p{N}]", "_")
    return F.regexp_replace(folded, "^_+|_+$", "")


def elapsed(seconds: Column) -> Column:
    s = F.greatest(F.lit(0).cast("bigint"), seconds.cast("bigint"))
    minutes = F.floor(s / 60)
    hours = F.floor(minutes / 60)
    return (
        F.when(s < 90, F.lit("moments ago"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes ago")))
        .when(hours == 1, F.lit("1 hour ago"))
        .otherwise(F.concat(hours.cast("string"), F.lit(" hours ago")))
    )


def range_key(path: Column, offset: Column, limit: Column) -> Column:
    """One requested range of one file; no offset means line 1 and no limit means 0."""
    start = F.coalesce(F.nullif(offset.cast("bigint"), F.lit(0).cast("bigint")), F.lit(1).cast("bigint"))
    return F.concat_ws("|", F.coalesce(path, F.lit("")), start.cast("string"), F.coalesce(limit.cast("bigint"), F.lit(0).cast("bigint")).cast("string"))


def file_stamp(size: Column, modified: Column) -> Column:
    """``size:mtime`` in nanoseconds of a TIMESTAMP; NULL when either is unknown."""
    return F.concat(size.cast("string"), F.lit(":"), (micros(modified) * 1000).cast("string"))
