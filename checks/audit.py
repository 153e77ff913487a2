"""Transcripts: reports from parsed lines here, from the tables they were made of in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import CALLS, USAGE, table, transcripts
from checks.registry import check
from logsift.plans import audit as A
from logsift.scratch import saved
from logsift.sources.surface import configured_servers
from logsift.sources.transcripts import drop_twins


def _lines(spark, sf):
    return drop_twins(transcripts(spark, sf))


def _entries(spark, sf):
    return A.entries(_lines(spark, sf))


def _parts(spark, sf):
    return saved(A.session_parts(_entries(spark, sf)), "sessions")


FILES = """paths AS (SELECT DISTINCT 'claude' AS runtime, path FROM turns UNION ALL SELECT DISTINCT 'codex', path FROM acts UNION ALL SELECT DISTINCT 'gemini', 'gemini/g' || (doc_id % 10) || '.jsonl' FROM documents)"""


@check("transcript_files", f"WITH {CALLS}, {FILES} SELECT path, runtime FROM paths UNION ALL SELECT 'other/tool.jsonl', NULL")
def q_files(spark, sf):
    return A.vendors(_lines(spark, sf))


@check("twin_files", "SELECT 'claude/c' || conv_id || '/' || CASE WHEN conv_id % 9 = 0 THEN 'transcript_full.jsonl' ELSE 'log.jsonl' END AS path, count(*) AS lines FROM conversations GROUP BY ALL")
def q_twins(spark, sf):
    kept = _lines(spark, sf).filter(F.col("path").startswith("claude/"))
    return kept.groupBy("path").agg(F.count(F.lit(1)).alias("lines"))


@check("file_quality", f"WITH {CALLS}, {FILES} SELECT count(*) AS files, 1 AS unrecognised_files, 0 AS unreadable_files FROM paths")
def q_quality(spark, sf):
    return A.file_quality(A.vendors(_lines(spark, sf)))


@check("tolerant_lines", "SELECT CASE WHEN event_id % 50 = 0 THEN 'yes' ELSE 'no' END AS beside_junk, count(*) AS objects FROM events GROUP BY ALL")
def q_tolerant(spark, sf):
    """Objects of the rollout files; junk lines share positions with every fiftieth of them."""
    codex = transcripts(spark, sf).filter(F.col("path").startswith("codex/"))
    found = A.objects(codex).withColumn("beside_junk", F.when(F.col("pos") % 50 == 0, "yes").otherwise("no"))
    return found.groupBy("beside_junk").agg(F.count(F.lit(1)).alias("objects"))


_KEYS = ", ".join(A.TOKEN_KEYS)


@check("usage_rows", f"WITH {USAGE} SELECT runtime, path, pos, session, is_sidechain, {_KEYS}, prompt_total, date FROM use")
def q_usage(spark, sf):
    return A.usage(_entries(spark, sf)).drop("block")


@check("audit_totals", f"""WITH {USAGE} SELECT count(*) AS requests, count(*) FILTER (WHERE is_sidechain) AS subagent_requests, {', '.join(f'sum({k}) AS {k}' for k in A.TOKEN_KEYS)},
  {', '.join(f'coalesce(sum({k}) FILTER (WHERE is_sidechain), 0) AS subagent_{k}' for k in A.TOKEN_KEYS)}, (SELECT count(*) FROM sess) AS sessions FROM use""")
def q_totals(spark, sf):
    return A.totals(_parts(spark, sf))


@check("session_floors", f"WITH {USAGE} SELECT * FROM sess")
def q_sessions(spark, sf):
    return A.sessions(_parts(spark, sf))


RUNTIMES = f"""{USAGE}, {FILES}, known AS (SELECT runtime, count(*) AS files FROM paths GROUP BY runtime),
tot AS (SELECT runtime, count(*) AS requests, {', '.join(f'sum({k}) AS {k}' for k in A.TOKEN_KEYS)} FROM use GROUP BY runtime),
med AS (SELECT runtime, CAST(floor(median(floor)) AS BIGINT) AS session_floor FROM sess WHERE floor > 0 GROUP BY runtime),
rts AS (SELECT runtime, files, coalesce(requests, 0) AS requests, CASE WHEN runtime = 'gemini' THEN (SELECT count(*) FROM documents) ELSE 0 END AS steps, runtime != 'gemini' AS tokens_available,
  {_KEYS}, session_floor, session_floor * requests AS floor_cost, cache_read_input_tokens AS context_read FROM known LEFT JOIN tot USING (runtime) LEFT JOIN med USING (runtime))"""


@check("runtime_floors", f"WITH {RUNTIMES} SELECT * FROM rts")
def q_runtimes(spark, sf):
    lines = _lines(spark, sf)
    files = saved(A.vendors(lines), "files")
    return A.runtimes(saved(A.session_parts(A.entries(lines, files)), "sessions"), files)


@check("fixed_cost", f"WITH {RUNTIMES} SELECT (SELECT CAST(floor(median(floor)) AS BIGINT) FROM sess WHERE floor > 0) AS session_floor, sum(requests) FILTER (WHERE tokens_available) AS requests, sum(floor_cost) AS floor_cost FROM rts")
def q_fixed_cost(spark, sf):
    return A.fixed_cost(_parts(spark, sf))


@check("subagent_share", f"""WITH {USAGE}, s AS (SELECT sum(cache_read_input_tokens) AS context_read, sum(cache_read_input_tokens) FILTER (WHERE is_sidechain) AS subagent_context_read FROM use)
SELECT *, round_even(subagent_context_read * 100.0 / context_read, 1) AS subagent_share_pct FROM s""")
def q_share(spark, sf):
    return A.subagent_share(_parts(spark, sf))


@check("tool_calls", f"WITH {CALLS} SELECT runtime, tool, count(*) AS calls FROM calls GROUP BY GROUPING SETS ((runtime, tool), (tool))")
def q_tool_calls(spark, sf):
    return A.calls_by_tool(A.tool_calls(_entries(spark, sf)))


@check("top_tools", f"WITH {CALLS} SELECT NULL AS runtime, tool, count(*) AS calls FROM calls GROUP BY tool ORDER BY calls DESC, tool LIMIT 6")
def q_top_tools(spark, sf):
    return A.top(A.calls_by_tool(A.tool_calls(_entries(spark, sf))).filter("runtime IS NULL"), "calls")


@check("tool_result_size", f"""WITH {CALLS}, linked AS (
  SELECT c.tool, CASE WHEN r.turn % 3 = 0 THEN length('{{"n": ' || r.turn || ', "ok": [1, 2]}}') ELSE length(r.text) END AS size
  FROM conversations AS r JOIN calls AS c ON c.runtime = 'claude' AND c.conv_id = r.conv_id AND c.turn = r.turn - 1 WHERE r.role = 'user'
  UNION ALL SELECT 'codex tool output', length(props) FROM events WHERE event_type = 'view')
SELECT tool, sum(size) AS size, count(*) AS results FROM linked WHERE size > 0 GROUP BY tool""")
def q_result_size(spark, sf):
    return A.result_sizes(A.tool_results(_entries(spark, sf)))


SERVERS = f"""{CALLS}, named AS (SELECT CASE conv_id % 4 WHEN 0 THEN 'Git Hub' ELSE 'Mail' END AS name, 1 AS a, 0 AS b FROM conversations WHERE role = 'assistant' AND conv_id % 4 < 2
  UNION ALL SELECT split_part(tool, '__', 2), 0, 1 FROM calls WHERE starts_with(tool, 'mcp__')),
spell AS (SELECT name, replace(lower(name), ' ', '_') AS server, sum(a) AS attributed, sum(b) AS namespaced, sum(a + b) AS calls FROM named GROUP BY name),
used AS (SELECT server, arg_max(name, calls * 2 + (namespaced > 0)::INT) AS label, sum(calls) AS calls, sum(attributed) AS attributed, sum(namespaced) AS namespaced FROM spell GROUP BY server)"""


@check("server_calls", f"WITH {SERVERS} SELECT * FROM used")
def q_server_calls(spark, sf):
    return A.server_calls(_entries(spark, sf))


def _configs(spark, sf):
    """Configuration documents made of customers: one per segment and kind, with a server or plugin each."""
    rows = table(spark, sf, "customer").selectExpr(
        "concat('conf', string(c_custkey % 5), '/', c_mktsegment, string(c_custkey)) AS path",
        "CASE c_custkey % 4 WHEN 0 THEN 'main' WHEN 1 THEN 'settings' WHEN 2 THEN 'extra' ELSE 'main' END AS kind",
        """CASE c_custkey % 4
            WHEN 0 THEN to_json(named_struct('mcpServers', map(concat('srv', string(c_custkey % 40)), map('cmd', 'x'), 'mail', map('cmd', 'y'))))
            WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN to_json(named_struct('enabledPlugins', map(concat('git@market', string(c_custkey % 3)), true, concat('off', string(c_custkey)), false)))
                ELSE to_json(named_struct('enabledPlugins', array(concat('plug', string(c_custkey % 16), '@m')))) END
            WHEN 2 THEN CASE WHEN c_custkey % 8 = 2 THEN 'not json' ELSE to_json(named_struct('mcpServers', map('search', 1))) END
            ELSE to_json(named_struct('projects', map(concat('p', string(c_custkey)), map('mcpServers', map(concat('srv', string(c_custkey % 40)), 1))))) END AS text""",
    )
    return rows


CONFIG = """conf AS (SELECT *, 'conf' || (c_custkey % 5) || '/' || c_mktsegment || c_custkey AS path FROM customer),
listed AS (
  SELECT 'srv' || (c_custkey % 40) AS name, path AS source, 1 AS rank FROM conf WHERE c_custkey % 4 = 0 UNION ALL SELECT 'mail', path, 1 FROM conf WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'srv' || (c_custkey % 40), path || ' (p' || c_custkey || ')', 2 FROM conf WHERE c_custkey % 4 = 3
  UNION ALL SELECT 'git@market' || (c_custkey % 3), path || ' enabledPlugins', 3 FROM conf WHERE c_custkey % 8 = 1
  UNION ALL SELECT 'plug' || (c_custkey % 16) || '@m', path || ' enabledPlugins', 3 FROM conf WHERE c_custkey % 8 = 5
  UNION ALL SELECT 'search', path, 4 FROM conf WHERE c_custkey % 8 = 6),
configured AS (SELECT name, arg_min(source, rank || source) AS source FROM listed GROUP BY name)"""


@check("configured_servers", f"WITH {CONFIG} SELECT * FROM configured")
def q_configured(spark, sf):
    return configured_servers(_configs(spark, sf))


IDLE = f"""{SERVERS}, {CONFIG}, stems AS (SELECT *, lower(split_part(name, '@', 1)) AS stem FROM configured),
idle AS (SELECT name, source FROM stems WHERE NOT EXISTS (SELECT 1 FROM used WHERE lower(label) = stem OR contains(replace(lower(label), '-', '_'), stem) OR contains(stem, lower(label))))"""


def _surface(spark, sf):
    used = saved(A.server_calls(_entries(spark, sf)), "servers")
    return saved(configured_servers(_configs(spark, sf)), "configured"), used


@check("idle_surface", f"WITH {IDLE} SELECT * FROM idle")
def q_idle(spark, sf):
    return A.idle_surface(*_surface(spark, sf))


@check("server_report", f"WITH {IDLE} SELECT label AS name, calls, coalesce(source, 'not in config') AS source, false AS idle FROM used LEFT JOIN configured ON label = name UNION ALL SELECT name, 0, source, true FROM idle")
def q_server_report(spark, sf):
    return A.server_report(*_surface(spark, sf))
