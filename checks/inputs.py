"""Inputs of the library derived from the driver's tables, and the same derivations in SQL.

Documents become captured outputs: the source picks a command, and the text is mixed with the noise that
command prints. Conversations, events and documents become transcripts, events become metric events and
request logs. All of them grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.functions.text import lit
from logsift.sources.outputs import spread

# One command per document source, and a line of the noise it prints (@ is the line number).
COMMANDS = [
    ("git status", '  (use "git add <file>..." to include @)'),
    ("python -m pip install -r requirements.txt", "Requirement already satisfied: package-@ in ./lib"),
    ("npm install", "npm warn deprecated package-@"),
    ("pytest -q tests", "..F.s. [ @%]"),
    ("ls -R /srv", "drwxr-xr-x @ folder"),
    ("git diff HEAD~1", "index abc@..def"),
    ("git log --oneline", "commit @"),
    ("git fetch origin", "Receiving objects: @% (1/2)"),
    ("cargo build --message-format=json", '{"reason":"compiler-artifact","n":@}'),
    ("make all", "gcc -c file@.c"),
    ("docker build .", "#@ DONE 0.1s"),
    ("webpack --mode production", "  asset main.@.js"),
    ("docker logs api", "2024-01-02T03:04:05Z INFO heartbeat id=@"),
    ("curl -s https://example.test/data", "  @ 100 200 0"),
    ("pkg install vim", "[@/99] Fetching pkg-@.txz: .......... done"),
    ("apt-get install jq", "Get:@ http://deb.example.test stable"),
    ("ssh host uptime", "Warning: Permanently added host @"),
    ("Get-VM | Format-List", "----  ---- -----"),
    ("rg -n pattern src", "src/main.rs:@: let x = @;"),
    ("rg --files-with-matches pattern src", "src/mod@/file.rs"),
]
_PICK = "int(substr(source, 4)) % 20"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "events"), "event_id")


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    columns = columns or ("doc_id", "text", "source")
    return spread(table(spark, sf, "documents").select(*columns), "doc_id")


def lines_as_items(spark: SparkSession, sf: str) -> DataFrame:
    """``id, lines`` of the noisy outputs."""
    return outputs(spark, sf).select("id", "command", F.expr("split(raw, '\\n', -1)").alias("lines"))


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    return noisy(documents(spark, sf))


_DEEP = "named_struct('a', named_struct('b', named_struct('c', named_struct('d', named_struct('e', named_struct('f', named_struct('g', split(lang, ''))))))))"
JSON_DOC = f"to_json(named_struct('id', doc_id, 'lang', lang, 'text', text, 'lines', split(text, '\\n', -1), 'deep', {_DEEP}))"


def mixed_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(documents(spark, sf, "doc_id", "text", "source", "lang"))


def mixed(docs: DataFrame) -> DataFrame:
    """Noisy outputs of which some are JSON documents and others only begin like one."""
    raw = f"""CASE doc_id % 11 WHEN 3 THEN concat(CASE WHEN doc_id % 7 = 0 THEN '\ufeff' ELSE '' END, {JSON_DOC})
        WHEN 7 THEN concat('[broken ', {_NOISY}) ELSE {_NOISY} END"""
    return noisy(docs, raw)


def noisy(docs: DataFrame, raw: str | None = None) -> DataFrame:
    return docs.select(
        F.col("doc_id").alias("id"),
        F.expr("timestamp_seconds(1704067200 + doc_id * 317)").alias("ts"),
        F.expr(f"element_at({_COMMANDS}, {_PICK} + 1)").alias("command"),
        F.expr("concat('/home/u', string(doc_id % 7))").alias("cwd"),
        F.expr("int(doc_id % 3)").alias("exit_code"),
        F.expr(raw or _NOISY).alias("raw"),
    )


def _noisy_text() -> str:
    noises = f"array({', '.join(lit(n) for _, n in COMMANDS)})"
    body = f"""array_join(flatten(transform(split(text, '\\n', -1), (l, i) -> concat(
        CASE WHEN i % 3 = 0 THEN array(replace(element_at({noises}, {_PICK} + 1), '@', string(i))) ELSE array() END,
        array(CASE WHEN i % 5 = 4 THEN concat('\\u001b[31m', l, '\\u001b[0m') ELSE l END),
        CASE WHEN i % 6 > 0 THEN transform(sequence(1, int(i % 6)), j ->
            concat('step ', string(doc_id * 10 + i * 100 + j), ' finished in ', string(j + 5), 'ms')) ELSE array() END
    ))), '\\n')"""
    return f"concat(CASE WHEN doc_id % 7 = 0 THEN '﻿' ELSE '' END, {body})"


_COMMANDS = f"array({', '.join(lit(c) for c, _ in COMMANDS)})"
_NOISY = _noisy_text()


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQL_PICK = "(CAST(substr(source, 4) AS INTEGER) % 20 + 1)"
OUTPUTS = f"""outputs AS MATERIALIZED (
  SELECT doc_id AS id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 317) AS ts,
    list_extract([{', '.join(_sql(c) for c, _ in COMMANDS)}], {_SQL_PICK}) AS command,
    '/home/u' || (doc_id % 7) AS cwd, CAST(doc_id % 3 AS INTEGER) AS exit_code,
    (CASE WHEN doc_id % 7 = 0 THEN chr(65279) ELSE '' END) || array_to_string(flatten(list_transform(
      string_split(text, chr(10)), lambda l, k: list_concat(
        CASE WHEN (k - 1) % 3 = 0 THEN [replace(list_extract([{', '.join(_sql(n) for _, n in COMMANDS)}], {_SQL_PICK}), '@', CAST(k - 1 AS VARCHAR))] ELSE [] END,
        [CASE WHEN (k - 1) % 5 = 4 THEN chr(27) || '[31m' || l || chr(27) || '[0m' ELSE l END],
        list_transform(range(1, (k - 1) % 6 + 1), lambda j: 'step ' || (doc_id * 10 + (k - 1) * 100 + j) || ' finished in ' || (j + 5) || 'ms')
      ))), chr(10)) AS raw
  FROM documents)"""

_LINES = """lines AS MATERIALIZED (
  SELECT id, command, unnest(string_split(raw, chr(10))) AS line, unnest(range(0, len(string_split(raw, chr(10))))) AS n FROM outputs)"""
LINES = f"{OUTPUTS}, {_LINES}"

JDOCS = """jdocs AS MATERIALIZED (SELECT doc_id AS id, lang, text, string_split(text, chr(10)) AS lines, len(lang) AS letters,
  CAST(to_json({id: doc_id, lang: lang, text: text, lines: string_split(text, chr(10)), deep: {a: {b: {c: {d: {e: {f: {g: string_split(lang, '')}}}}}}}}) AS VARCHAR) AS raw FROM documents)"""
_CUT = lambda s: f"CASE WHEN length({s}) > 200 THEN left({s}, 200) || '… ⟨+' || (length({s}) - 200) || ' chars⟩' ELSE {s} END"
VIEWS = JDOCS + f""", views AS (SELECT id, raw, '{{' || chr(10) || '  "id": ' || id || ',' || chr(10) || '  "lang": "' || lang || '",' || chr(10) ||
  '  "text": ' || to_json({_CUT('text')}) || ',' || chr(10) || '  "lines": [' || chr(10) || array_to_string(list_concat(
    list_transform(lines[1:8], lambda l: '    ' || to_json({_CUT('l')})),
    CASE WHEN len(lines) > 8 THEN ['    "… ⟨' || (len(lines) - 8) || ' more of ' || len(lines) || ' items⟩"'] ELSE [] END), ',' || chr(10)) || chr(10) || '  ],' || chr(10) ||
  '  "deep": {{' || chr(10) || '    "a": {{' || chr(10) || '      "b": {{' || chr(10) || '        "c": {{' || chr(10) || '          "d": {{' || chr(10) ||
  '            "e": {{' || chr(10) || '              "f": {{' || chr(10) || '                "g": "⟨array of ' || letters || ' items elided at depth limit⟩"' || chr(10) ||
  '              }}' || chr(10) || '            }}' || chr(10) || '          }}' || chr(10) || '        }}' || chr(10) || '      }}' || chr(10) || '    }}' || chr(10) || '  }}' || chr(10) || '}}' AS view FROM jdocs)"""
MIXED_OUTPUTS = f"""{OUTPUTS.replace('outputs AS', 'noisy AS', 1)}, {VIEWS}, outputs AS MATERIALIZED (SELECT n.* REPLACE (
  CASE WHEN n.id % 11 = 3 THEN (CASE WHEN n.id % 7 = 0 THEN chr(65279) ELSE '' END) || v.raw WHEN n.id % 11 = 7 THEN '[broken ' || n.raw ELSE n.raw END AS raw) FROM noisy AS n JOIN views AS v USING (id))"""
MIXED_LINES = f"{MIXED_OUTPUTS}, {_LINES}"


def metric_events(spark: SparkSession, sf: str) -> DataFrame:
    return metric_columns(events(spark, sf))


def metric_columns(events: DataFrame) -> DataFrame:
    k = "int(get_json_object(props, '$.k'))"
    return events.select(
        F.expr("element_at(array('codex', ' Claude-Code ', 'GEMINI', 'localagent', 'antigravity', 'weird'), int(user_id % 6) + 1)").alias("client"),
        F.expr("CASE WHEN event_type IN ('click', 'view') THEN 'observe' WHEN event_type = 'signup' THEN 'input' ELSE 'run' END").alias("kind"),
        F.expr(f"{k} % 2 = 0").alias("flag"),
        F.expr(f"bigint({k} * 100)").alias("raw_tokens"),
        F.expr(f"bigint({k} * 37)").alias("output_tokens"),
        F.expr("bigint(round(value * 100)) * 10000").alias("process_ns"),
        "ts",
    )


METRICS = """metrics AS (
  SELECT CASE user_id % 6 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'local' WHEN 4 THEN 'gemini' ELSE 'unknown' END AS client,
    CASE WHEN event_type IN ('click', 'view') THEN 'observe' WHEN event_type = 'signup' THEN 'input' ELSE 'run' END AS kind,
    k % 2 = 0 AS flag, k * 100 AS raw_tokens, k * 37 AS output_tokens, CAST(round(value * 100) AS BIGINT) * 10000 AS process_ns, ts
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return request_columns(events(spark, sf))


def request_columns(events: DataFrame) -> DataFrame:
    keyed = events.withColumn("k", F.expr("int(get_json_object(props, '$.k'))"))
    return keyed.select(
        F.expr("concat('s', string(user_id % 3))").alias("session"),
        F.col("event_id").alias("seq"),
        "ts",
        F.expr("concat('/src/', event_type, '.py')").alias("path"),
        F.expr("CASE WHEN k % 7 = 0 THEN 400L WHEN k % 7 = 1 THEN 0L END").alias("offset"),
        F.expr("CASE WHEN k % 5 = 0 THEN 100L END").alias("limit"),
        F.expr("CASE WHEN k != 98 THEN concat(string(int(k / 50)), ':7') END").alias("stamp"),
        F.expr("k = 99").alias("is_reset"),
        F.expr("bigint(k) * 4000").alias("size_bytes"),
        F.expr("CASE WHEN k % 2 = 0 THEN 'content' WHEN k % 3 = 0 THEN 'count' END").alias("output_mode"),
        F.expr("CASE WHEN k % 6 = 0 THEN bigint(k) END").alias("head_limit"),
    )


REQUESTS = """reqs AS MATERIALIZED (
  SELECT 's' || (user_id % 3) AS session, event_id AS seq, ts, '/src/' || event_type || '.py' AS path,
    CASE WHEN k % 7 = 0 THEN 400 WHEN k % 7 = 1 THEN 0 END AS "offset", CASE WHEN k % 5 = 0 THEN 100 END AS "limit",
    CASE WHEN k != 98 THEN (k // 50) || ':7' END AS stamp, k = 99 AS is_reset, k * 4000 AS size_bytes,
    CASE WHEN k % 2 = 0 THEN 'content' WHEN k % 3 = 0 THEN 'count' END AS output_mode,
    CASE WHEN k % 6 = 0 THEN k END AS head_limit
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """``path, block, pos, line`` of three kinds of transcripts, a twin, a foreign file and junk lines."""
    talk = table(spark, sf, "conversations")
    assistant = """to_json(named_struct(
        'type', 'assistant', 'sessionId', concat('s', string(conv_id)),
        'timestamp', concat('2026-07-', lpad(string(turn % 28 + 1), 2, '0'), 'T10:00:00Z'),
        'isSidechain', turn % 5 = 3,
        'attributionMcpServer', CASE WHEN conv_id % 4 = 0 THEN 'Git Hub' WHEN conv_id % 4 = 1 THEN 'Mail' END,
        'message', named_struct(
            'usage', named_struct('input_tokens', length(text) % 50, 'output_tokens', length(text) % 90,
                'cache_creation_input_tokens', length(text), 'cache_read_input_tokens', 1000 + conv_id * 10 + turn),
            'content', array(named_struct('type', 'text', 'id', CAST(NULL AS STRING), 'name', CAST(NULL AS STRING)),
                named_struct('type', 'tool_use', 'id', concat('t', string(conv_id), '_', string(turn)),
                    'name', element_at(array('Read', 'mcp__git_hub__get', 'mcp__search__find', 'Bash'), int(turn % 4) + 1))))))"""
    user = """to_json(named_struct(
        'type', 'user', 'sessionId', concat('s', string(conv_id)),
        'toolUseResult', {0},
        'message', named_struct('content', array(named_struct('type', 'tool_result',
            'tool_use_id', concat('t', string(conv_id), '_', string(turn - 1)))))))"""
    claude = talk.select(
        F.expr("concat('claude/c', string(conv_id), '/', CASE WHEN conv_id % 9 = 0 THEN 'transcript_full.jsonl' ELSE 'log.jsonl' END)").alias("path"),
        F.lit(0).cast("bigint").alias("block"),
        F.col("turn").alias("pos"),
        F.expr(
            f"CASE role WHEN 'assistant' THEN {assistant} "
            f"WHEN 'user' THEN CASE WHEN turn % 3 = 0 THEN {user.format("named_struct('n', turn, 'ok', array(1, 2))")} ELSE {user.format('text')} END "
            "ELSE to_json(named_struct('type', 'system', 'sessionId', concat('s', string(conv_id)))) END"
        ).alias("line"),
        "conv_id",
    )
    twins = claude.filter("conv_id % 9 = 0").withColumn("path", F.expr("replace(path, '_full', '')"))
    happened = events(spark, sf).withColumn("k", F.expr("int(get_json_object(props, '$.k'))"))
    codex = happened.select(
        F.expr("concat('codex/u', string(user_id % 20), '.jsonl')").alias("path"),
        F.expr("event_id div 4096").alias("block"),
        F.col("event_id").alias("pos"),
        F.expr("""CASE event_type
            WHEN 'signup' THEN to_json(named_struct('type', 'session_meta', 'payload', named_struct('type', 'start')))
            WHEN 'error' THEN to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call', 'name', concat('tool', string(k % 4)))))
            WHEN 'view' THEN to_json(named_struct('type', 'response_item', 'payload', named_struct('type', 'function_call_output', 'output', props)))
            ELSE to_json(named_struct('type', 'event_msg', 'timestamp', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
                'payload', named_struct('type', 'token_count', 'info', named_struct('last_token_usage', named_struct(
                    'input_tokens', k * 100, 'cached_input_tokens', k * 60 + 10, 'output_tokens', k, 'reasoning_output_tokens', k % 3))))) END""").alias("line"),
    )
    junk = codex.filter("pos % 50 = 0").select("path", "block", (F.col("pos")).alias("pos"), F.lit("not json").alias("line"))
    gemini = table(spark, sf, "documents").select(
        F.expr("concat('gemini/g', string(doc_id % 10), '.jsonl')").alias("path"),
        F.expr("doc_id div 4096").alias("block"),
        F.col("doc_id").alias("pos"),
        F.expr("""to_json(named_struct('step_index', doc_id, 'created_at', 'x', 'type', 'PLANNER',
            'tool_calls', array(named_struct('tool_name', concat('view_', lang)))))""").alias("line"),
    )
    foreign = table(spark, sf, "labels").select(
        F.lit("other/tool.jsonl").alias("path"), F.lit(0).cast("bigint").alias("block"), F.col("doc_id").alias("pos"),
        F.lit('{"some": "other tool"}').alias("line"),
    )
    parts = [claude.drop("conv_id"), twins.drop("conv_id"), codex, junk, gemini, foreign]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# The same facts, straight from the tables.
CALLS = """turns AS (SELECT *, 'claude/c' || conv_id || '/' || CASE WHEN conv_id % 9 = 0 THEN 'transcript_full.jsonl' ELSE 'log.jsonl' END AS path FROM conversations),
acts AS (SELECT *, 'codex/u' || (user_id % 20) || '.jsonl' AS path, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
calls AS (
  SELECT 'claude' AS runtime, path, turn AS pos, list_extract(['Read', 'mcp__git_hub__get', 'mcp__search__find', 'Bash'], CAST(turn % 4 + 1 AS INTEGER)) AS tool,
    conv_id, turn FROM turns WHERE role = 'assistant'
  UNION ALL SELECT 'codex', path, event_id, 'tool' || (k % 4), NULL, NULL FROM acts WHERE event_type = 'error'
  UNION ALL SELECT 'gemini', 'gemini/g' || (doc_id % 10) || '.jsonl', doc_id, 'view_' || lang, NULL, NULL FROM documents)"""
USAGE = f"""{CALLS}, use AS (
  SELECT 'claude' AS runtime, path, turn AS pos, 's' || conv_id AS session, turn % 5 = 3 AS is_sidechain,
    length(text) % 50 AS input_tokens, length(text) % 90 AS output_tokens, length(text) AS cache_creation_input_tokens,
    1000 + conv_id * 10 + turn AS cache_read_input_tokens,
    length(text) % 50 + length(text) + 1000 + conv_id * 10 + turn AS prompt_total,
    '2026-07-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') AS date
  FROM turns WHERE role = 'assistant'
  UNION ALL
  SELECT 'codex', path, event_id, path, false, greatest(k * 100 - (k * 60 + 10), 0), k + k % 3, 0, k * 60 + 10, k * 100, strftime(ts, '%Y-%m-%d')
  FROM acts WHERE event_type IN ('click', 'purchase') AND (k * 100 != 0 OR k != 0)),
sess AS (
  SELECT runtime, session, count(*) AS requests, arg_max(date, pos) AS date,
    coalesce(min(CASE WHEN prompt_total > 0 THEN prompt_total END), 0) AS floor, max(prompt_total) AS peak,
    sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
    sum(cache_creation_input_tokens) AS cache_creation_input_tokens, sum(cache_read_input_tokens) AS cache_read_input_tokens
  FROM use WHERE NOT is_sidechain GROUP BY ALL)"""


def store(spark: SparkSession, sf: str) -> DataFrame:
    """Every noisy output as a row of the recall table, compressed or not."""
    from logsift.functions.text import tokens

    return outputs(spark, sf).select(
        F.col("id"), "ts", "command", "cwd", "exit_code", "raw",
        F.expr(tokens("raw")).alias("raw_tokens"), F.expr("bigint(length(raw) div 9)").alias("comp_tokens"),
        F.concat(F.lit("f"), F.col("id") % 3).alias("filt"),
    )


def tokens_sql(text: str) -> str:
    return f"CASE WHEN length({text}) = 0 THEN 0 ELSE greatest(1, CAST(round_even(length({text}) / 4.0, 0) AS BIGINT)) END"


STORE = f"""{OUTPUTS}, store AS (
  SELECT id, ts, command, cwd, exit_code, raw, {tokens_sql('raw')} AS raw_tokens, length(raw) // 9 AS comp_tokens, 'f' || (id % 3) AS filt FROM outputs)"""
