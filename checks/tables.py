"""JSON documents, the recall table, scalar functions, request logs and packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import _CUT, JDOCS, JSON_DOC, OUTPUTS, REQUESTS, STORE, VIEWS, documents, outputs, requests, store, table, tokens_sql
from checks.registry import check
from logsift.functions import labels
from logsift.functions import payload as P
from logsift.functions.jsonview import is_json, json_view
from logsift.operators import jsonshape, packs, search
from logsift.operators import requests as R
from logsift.operators import selection
from logsift.operators import store as S
from logsift.options import Options

# ---- JSON -------------------------------------------------------------------------------------

_DOC = JSON_DOC


def json_docs(spark, sf):
    return documents(spark, sf, "doc_id", "text", "lang").select(F.col("doc_id").alias("id"), F.expr(_DOC).alias("raw"))


_cut = _CUT


@check("json_views", f"WITH {VIEWS} SELECT id, view FROM views")
def q_json_views(spark, sf):
    return json_docs(spark, sf).select("id", json_view(F.col("raw")).alias("view"))


@check("json_report", f"WITH {VIEWS}, t AS (SELECT id, {tokens_sql('raw')} AS tokens_before, {tokens_sql('view')} AS tokens_after FROM views) SELECT *, round_even((tokens_before - tokens_after) * 100 / tokens_before, 1) AS saved_pct FROM t")
def q_json_report(spark, sf):
    return jsonshape.json_report(json_docs(spark, sf))


# A JSON output whose view is no shorter is line work: one line of a curl command, so clipped if it is long.
_CLIPPED = "CASE WHEN length(raw) > 800 THEN left(raw, 800) || '… ⟨+' || (length(raw) - 800) || ' chars⟩' ELSE raw END"


@check("json_compress", f"""WITH {VIEWS}, t AS (SELECT id, {tokens_sql('raw')} AS raw_tokens, raw, length(view) < length(raw) AS js, CASE WHEN length(view) < length(raw) THEN view ELSE {_CLIPPED} END AS body FROM views),
a AS (SELECT *, {tokens_sql('body')} AS after FROM t), v AS (SELECT *, raw_tokens < 40 OR body = raw OR (raw_tokens - after) / raw_tokens < 0.15 AS through FROM a)
SELECT id, raw_tokens, CASE WHEN through THEN raw_tokens ELSE after END AS comp_tokens, CASE WHEN through THEN 'passthrough' WHEN js THEN 'json' ELSE 'clip-monster-lines' END AS label, md5(CASE WHEN through THEN raw ELSE body END) AS body FROM v""")
def q_json_compress(spark, sf):
    """JSON outputs through the pipeline."""
    from logsift.plans.compression import compress

    done = compress(json_docs(spark, sf).withColumn("command", F.lit("curl")))
    return done.select("id", "raw_tokens", "comp_tokens", "label", F.md5("body").alias("body"))


@check("json_rows", "SELECT doc_id AS id, doc_id % 4 IN (0, 2) AS json FROM documents")
def q_json_rows(spark, sf):
    raw = F.expr(f"CASE doc_id % 4 WHEN 0 THEN {_DOC} WHEN 1 THEN concat('[broken ', text) WHEN 2 THEN concat('  ', to_json(split(text, ' '))) ELSE text END")
    docs = documents(spark, sf, "doc_id", "text", "lang")
    return docs.select(F.col("doc_id").alias("id"), F.coalesce(is_json(raw), F.lit(False)).alias("json"))


_NODES = JDOCS + """, nodes AS (
  SELECT '$' AS path, 0 AS depth, 'object' AS kind, 5 AS size FROM jdocs
  UNION ALL SELECT '$.id', 1, 'number', NULL FROM jdocs UNION ALL SELECT '$.lang', 1, 'string', length(lang) FROM jdocs
  UNION ALL SELECT '$.text', 1, 'string', length(text) FROM jdocs UNION ALL SELECT '$.lines', 1, 'array', len(lines) FROM jdocs
  UNION ALL SELECT '$.lines[]', 2, 'string', length(l) FROM (SELECT unnest(lines) AS l FROM jdocs)
  UNION ALL SELECT p.path, p.depth, 'object', 1 FROM jdocs, (VALUES ('$.deep', 1), ('$.deep.a', 2), ('$.deep.a.b', 3), ('$.deep.a.b.c', 4), ('$.deep.a.b.c.d', 5), ('$.deep.a.b.c.d.e', 6), ('$.deep.a.b.c.d.e.f', 7)) AS p(path, depth)
  UNION ALL SELECT '$.deep.a.b.c.d.e.f.g', 8, 'array', letters FROM jdocs)"""


@check("json_shape", f"WITH {_NODES} SELECT path, depth, kind, count(*) AS nodes, max(size) AS largest FROM nodes GROUP BY ALL")
def q_json_shape(spark, sf):
    return jsonshape.json_shape(jsonshape.json_nodes(json_docs(spark, sf)))


@check("json_hidden", f"""WITH {_NODES} SELECT path, coalesce(sum(size - 8) FILTER (WHERE kind = 'array' AND size > 8 AND depth < 8), 0) AS items_hidden,
  coalesce(sum(size - 200) FILTER (WHERE kind = 'string' AND size > 200), 0) AS chars_hidden, count(*) FILTER (WHERE depth = 8 AND kind IN ('array', 'object')) AS containers_elided
  FROM nodes GROUP BY path HAVING items_hidden + chars_hidden + containers_elided > 0""")
def q_json_hidden(spark, sf):
    return jsonshape.json_hidden(jsonshape.json_nodes(json_docs(spark, sf)))


@check("json_array_truncate", f"""WITH t AS (SELECT doc_id AS id, string_split(text, chr(10)) AS lines FROM documents)
SELECT id, array_to_string(list_transform(lines[1:8], lambda l: {_cut('l')}), chr(10)) AS items, greatest(len(lines) - 8, 0) AS hidden, len(lines) AS total FROM t""")
def q_json_array_truncate(spark, sf):
    docs = documents(spark, sf, "doc_id", "text").withColumn("cut", jsonshape.cut_array(F.split("text", "\n", -1)))
    clipped = F.transform("cut.items", lambda l: jsonshape.cut_string(l))
    return docs.select(F.col("doc_id").alias("id"), F.array_join(clipped, "\n").alias("items"), "cut.hidden", "cut.total")


# ---- recall table -----------------------------------------------------------------------------


@check("recent", f"WITH {STORE} SELECT id, ts, raw_tokens FROM store ORDER BY ts DESC, id LIMIT 20")
def q_recent(spark, sf):
    return S.recent(store(spark, sf)).select("id", "ts", "raw_tokens")


@check("discover", f"WITH {STORE}, r AS (SELECT * FROM store ORDER BY ts DESC, id LIMIT 500) SELECT id, raw_tokens, command FROM r ORDER BY raw_tokens DESC, ts DESC, id LIMIT 15")
def q_discover(spark, sf):
    return S.discover(store(spark, sf)).select("id", "raw_tokens", "command")


@check("row_cap", f"WITH {STORE} SELECT id, ts FROM store ORDER BY ts DESC, id LIMIT 150")
def q_row_cap(spark, sf):
    return S.cap_rows(store(spark, sf), 150).select("id", "ts")


@check("byte_cap", f"WITH {STORE}, s AS (SELECT id, ts, sum(strlen(raw)) OVER (ORDER BY ts DESC, id) AS upto FROM store) SELECT id, ts FROM s WHERE upto <= 400000")
def q_byte_cap(spark, sf):
    return S.cap_bytes(store(spark, sf), 400_000).select("id", "ts")


@check("event_cap", "SELECT event_id AS id, ts FROM (SELECT event_id, ts, sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY ts DESC) AS upto FROM events) WHERE upto <= 2000000")
def q_event_cap(spark, sf):
    """The newest events worth at most 20,000 together: the same cap with another weight."""
    rows = table(spark, sf, "events").withColumnRenamed("event_id", "id")
    return S.keep_newest(rows, F.expr("bigint(round(value * 100))"), 2_000_000).select("id", "ts")


_CAP = 1000


@check("payload_cap", f"""WITH t AS (SELECT doc_id AS id, text, CASE WHEN strlen(text) > {_CAP} THEN list_max(list_filter(range({_CAP // 4}, {_CAP + 1}), lambda n: strlen(left(text, n)) <= {_CAP})) END AS n FROM documents)
SELECT id, CASE WHEN n IS NULL THEN text ELSE left(text, n) || chr(10) || '[stored head only, ' || format('{{:,}}', strlen(text) - strlen(left(text, n))) || ' more bytes dropped at the 1,000-byte per-output cap]' || chr(10) END AS raw FROM t""")
def q_payload_cap(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), P.capped(F.col("text"), _CAP).alias("raw"))


_NAMED = f"{OUTPUTS}, named AS MATERIALIZED (SELECT id, sha256(id || chr(10) || raw) AS name FROM outputs)"


@check("handles", f"""WITH {_NAMED}, short AS (SELECT id, unnest(range(4, 65)) AS n, name FROM named), taken AS (SELECT left(name, n) AS h FROM short GROUP BY 1 HAVING count(*) > 1)
SELECT id, left(name, CAST(min(n) AS INTEGER)) AS handle FROM short WHERE left(name, n) NOT IN (SELECT h FROM taken) GROUP BY id, name""")
def q_handles(spark, sf):
    """Shortest unique prefixes, here from 4 characters on so that some have to grow."""
    named = outputs(spark, sf).select("id", P.digest(F.col("id"), F.col("raw")).alias("name"))
    return S.with_handles(named, shortest=4).select("id", "handle")


@check("recall_handle", f"WITH {_NAMED} SELECT o.id, o.raw FROM outputs AS o JOIN named USING (id) WHERE name LIKE (SELECT left(name, 6) FROM named WHERE id = 42) || '%'")
def q_recall(spark, sf):
    named = outputs(spark, sf).withColumn("name", P.digest(F.col("id"), F.col("raw")))
    handle = named.filter("id = 42").first().name[:6]
    return S.recall(named, handle).select("id", "raw")


_TERMS = r"list_filter(regexp_split_to_array(strip_accents(lower({0})), '[^\p{{L}}\p{{N}}]+'), lambda t: t != '')"


@check("postings", f"""WITH {STORE}, words AS (SELECT id, 'command' AS field, unnest({_TERMS.format('command')}) AS term FROM store UNION ALL SELECT id, 'raw', unnest({_TERMS.format('raw')}) FROM store)
SELECT term, field, count(*) AS uses, count(DISTINCT id) AS outputs FROM words GROUP BY ALL""")
def q_postings(spark, sf):
    index = search.postings(store(spark, sf))
    return index.groupBy("term", "field").agg(F.sum("tf").alias("uses"), F.count(F.lit(1)).alias("outputs"))


def _search_sql(words: list[str]) -> str:
    every = " AND ".join(f"list_contains(list_concat({_TERMS.format('command')}, {_TERMS.format('raw')}), '{w}')" for w in words)
    return f"WITH {STORE} SELECT id, ts, command FROM store WHERE {every} ORDER BY ts DESC, id LIMIT 10"


@check("search_terms", _search_sql(["main", "let", "pattern"]))
def q_search_terms(spark, sf):
    rows = store(spark, sf)
    return search.search_terms(rows, search.postings(rows), "Main LÉT pattern").select("id", "ts", "command")


def _words_sql(condition: str) -> str:
    """Newest rows by a condition on ``c`` and ``r``, the words of either field with a blank around each."""
    blanks = lambda field: f"(' ' || array_to_string({_TERMS.format(field)}, ' ') || ' ')"
    return f"WITH {STORE}, worded AS (SELECT id, ts, command, {blanks('command')} AS c, {blanks('raw')} AS r FROM store) SELECT id, ts, command FROM worded WHERE {condition} ORDER BY ts DESC, id LIMIT 10"


def _q_words(spark, sf, query):
    rows = store(spark, sf)
    return search.search_terms(rows, search.postings(rows), query).select("id", "ts", "command")


_HAS = "(contains(c, ' {0} ') OR contains(r, ' {0} '))"


@check("search_phrase", _words_sql(_HAS.format("finished in 6ms step") + " AND " + _HAS.format("src main rs 0 let")))
def q_search_phrase(spark, sf):
    """Words next to one another, over the marks between them and the lines."""
    return _q_words(spark, sf, '"finished in 6ms step" "src/main.rs:0: LET"')


@check("search_or", _words_sql(f"(({_HAS.format('fetching')} OR {_HAS.format('heartbeat id')}) AND NOT {_HAS.format('the')}) OR contains(c, ' uptime ')"))
def q_search_or(spark, sf):
    return _q_words(spark, sf, '(fetching OR "heartbeat id") NOT the OR command:uptime')


@check("search_prefix", _words_sql("(contains(c, ' deprec') OR contains(r, ' deprec')) AND (contains(c, ' depr') OR contains(r, ' warn depr'))"))
def q_search_prefix(spark, sf):
    return _q_words(spark, sf, 'deprec* "warn depr"*')


@check("search_like", f"WITH {STORE} SELECT id, ts, command FROM store WHERE lower(command) LIKE '%l_gs api%' OR contains(lower(raw), 'no such text') ORDER BY ts DESC, id LIMIT 10")
def q_search_like(spark, sf):
    return search.search_like(store(spark, sf), "L_GS api").select("id", "ts", "command")


@check("search_fallback", f"WITH {STORE} SELECT id, ts, command FROM store WHERE lower(raw) LIKE '%inished in 6m%' ORDER BY ts DESC, id LIMIT 10")
def q_search_fallback(spark, sf):
    """Word search finds no word ``5m``, so substring search answers."""
    rows = store(spark, sf)
    return search.search(rows, search.postings(rows), "inished in 6m").select("id", "ts", "command")


# ---- scalar functions -------------------------------------------------------------------------

_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@check("client_labels", f"""SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'codex' WHEN 1 THEN 'claude' WHEN 2 THEN 'gemini' WHEN 3 THEN 'local' ELSE 'unknown' END AS named,
  CASE WHEN user_id % 5 = 0 THEN 'codex' WHEN {_K} % 4 = 0 THEN 'gemini' WHEN {_K} % 4 = 1 THEN 'claude' WHEN {_K} % 4 = 2 THEN 'local' ELSE 'unknown' END AS found FROM events""")
def q_client_labels(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.expr("int(get_json_object(props, '$.k'))"))
    name = F.expr("element_at(array('CODEX ', 'claude-code', 'Antigravity', 'lmstudio', 'other'), int(user_id % 5) + 1)")
    env = F.expr("""CASE k % 4 WHEN 0 THEN map('LOGSIFT_CLIENT', 'gemini', 'CODEX_HOME', 'x') WHEN 1 THEN map('CLAUDECODE', '1', 'LOCALAGENT', '1')
        WHEN 2 THEN map('LOCAL_AGENT', '1', 'CODEX_HOME', '') ELSE map('PATH', '/bin') END""")
    explicit = F.expr("CASE WHEN user_id % 5 = 0 THEN 'codex' WHEN user_id % 5 = 1 THEN '' END")
    return events.select("event_id", labels.client_label(name).alias("named"), labels.client_from_markers(explicit, env).alias("found"))


@check("names", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS server, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS canonical FROM customer""")
def q_names(spark, sf):
    rows = table(spark, sf, "customer")
    tool = F.expr("CASE WHEN c_custkey % 2 = 0 THEN concat('mcp__', c_mktsegment, '__get') WHEN c_custkey % 3 = 0 THEN concat('mcp__', c_mktsegment) ELSE c_mktsegment END")
    return rows.select("c_custkey", labels.namespace(tool).alias("server"), labels.canonical(F.concat(F.lit(" #"), "c_name", F.lit("! "))).alias("canonical"))


@check("elapsed", f"""WITH s AS (SELECT event_id, greatest(0, {_K} * 137 - 500) AS s FROM events)
SELECT event_id, CASE WHEN s < 90 THEN 'moments ago' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s // 3600 = 1 THEN '1 hour ago' ELSE (s // 3600) || ' hours ago' END AS age FROM s""")
def q_elapsed(spark, sf):
    return table(spark, sf, "events").select("event_id", labels.elapsed(F.expr("int(get_json_object(props, '$.k')) * 137 - 500")).alias("age"))


_KEY = """path || '|' || coalesce(nullif("offset", 0), 1) || '|' || coalesce("limit", 0)"""


@check("range_keys", f"WITH {REQUESTS} SELECT seq, {_KEY} AS key, size_bytes || ':' || (epoch_us(ts) * 1000) AS stamp FROM reqs")
def q_range_keys(spark, sf):
    return requests(spark, sf).select("seq", labels.range_key(F.col("path"), F.col("offset"), F.col("limit")).alias("key"), labels.file_stamp(F.col("size_bytes"), F.col("ts")).alias("stamp"))


# ---- request logs -----------------------------------------------------------------------------

EPOCHS = REQUESTS + f""", eps AS MATERIALIZED (SELECT *, {_KEY} AS key, sum(CAST(is_reset AS INTEGER)) OVER (PARTITION BY session ORDER BY ts, seq) AS epoch FROM reqs)"""
# The ledger replayed request by request.
REPLAY = EPOCHS + """, live AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session, epoch, key ORDER BY ts, seq) AS rn FROM eps WHERE NOT is_reset AND stamp IS NOT NULL),
replay AS (
  SELECT session, epoch, key, rn, seq, ts, stamp, ts AS served_at, false AS suppressed FROM live WHERE rn = 1
  UNION ALL
  SELECT l.session, l.epoch, l.key, l.rn, l.seq, l.ts, l.stamp,
    CASE WHEN p.stamp = l.stamp AND NOT p.suppressed AND epoch_us(l.ts) - epoch_us(p.served_at) <= 7200000000 AND epoch_us(l.ts) - epoch_us(p.served_at) >= 1000000 THEN p.served_at ELSE l.ts END,
    p.stamp = l.stamp AND NOT p.suppressed AND epoch_us(l.ts) - epoch_us(p.served_at) <= 7200000000 AND epoch_us(l.ts) - epoch_us(p.served_at) >= 1000000
  FROM replay AS p JOIN live AS l ON l.session = p.session AND l.epoch = p.epoch AND l.key = p.key AND l.rn = p.rn + 1)"""
DECIDED = REPLAY + """, decided AS (SELECT e.*, CASE WHEN r.suppressed THEN 'suppress' ELSE 'serve' END AS decision, r.served_at FROM eps AS e LEFT JOIN replay AS r ON r.seq = e.seq WHERE NOT e.is_reset)"""


@check("forget_epochs", f"WITH {EPOCHS} SELECT seq, session, epoch FROM eps")
def q_epochs(spark, sf):
    return R.epochs(requests(spark, sf)).select("seq", "session", "epoch")


@check("repeat_reads", f"WITH RECURSIVE {DECIDED} SELECT seq, key, epoch, decision, served_at FROM decided")
def q_repeat_reads(spark, sf):
    return R.repeat_reads(requests(spark, sf)).select("seq", "key", "epoch", "decision", "served_at")


# A burst of one key with half of the rows, several to a microsecond; rows without a time or a session.
SKEWED = REQUESTS.replace("reqs AS", "even AS", 1) + """, reqs AS MATERIALIZED (SELECT * REPLACE (
  CASE WHEN seq % 5 = 0 THEN NULL WHEN seq % 2 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' + to_seconds(seq // 64) ELSE ts END AS ts,
  CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 2 = 0 THEN 'hot' ELSE session END AS session, CASE WHEN seq % 2 = 0 THEN '/src/hot.py' ELSE path END AS path,
  CASE WHEN seq % 2 = 1 THEN "offset" END AS "offset", CASE WHEN seq % 2 = 1 THEN "limit" END AS "limit", CASE WHEN seq % 2 = 0 THEN (seq // 1024) || ':1' ELSE stamp END AS stamp) FROM even)"""
SKEWED_DECIDED = DECIDED.replace(REQUESTS, SKEWED, 1).replace("ORDER BY ts, seq) AS epoch", "ORDER BY ts NULLS FIRST, seq) AS epoch").replace("AND stamp IS NOT NULL)", "AND stamp IS NOT NULL AND ts IS NOT NULL AND session IS NOT NULL)")


@check("repeat_reads_skewed", f"WITH RECURSIVE {SKEWED_DECIDED} SELECT seq, key, epoch, decision, served_at FROM decided")
def q_repeat_reads_skewed(spark, sf):
    """Blocks small enough that the burst and the rows without a time lie in many of them."""
    hot = lambda value, name: F.expr(f"CASE WHEN seq % 2 = 0 THEN {value} ELSE {name} END")
    log = requests(spark, sf).withColumns({
        "ts": F.expr("CASE WHEN seq % 5 != 0 THEN IF(seq % 2 = 0, TIMESTAMP_NTZ '2024-01-15 00:00:00' + make_dt_interval(0, 0, 0, seq div 64), ts) END"),
        "session": F.expr("CASE WHEN seq % 7 = 0 THEN NULL WHEN seq % 2 = 0 THEN 'hot' ELSE session END"), "path": hot("'/src/hot.py'", "path"),
        "offset": hot("NULL", "offset"), "limit": hot("NULL", "limit"), "stamp": hot("concat(string(seq div 1024), ':1')", "stamp"),
    })
    return R.repeat_reads(log, Options(block_rows=200)).select("seq", "key", "epoch", "decision", "served_at")


LEDGER = REPLAY + """, ledger AS (SELECT r.session, r.key, arg_max(r.stamp, r.rn) AS stamp, arg_max(r.served_at, r.rn) AS served_at, arg_max(r.suppressed, r.rn) AS suppressed
  FROM replay AS r JOIN (SELECT session, max(epoch) AS epoch FROM eps GROUP BY session) AS now ON r.session = now.session AND r.epoch = now.epoch GROUP BY r.session, r.key),
held AS (SELECT * FROM ledger WHERE epoch_us(served_at) >= epoch_us(TIMESTAMP '2024-01-30 12:00:00') - 28800000000)"""


def ledger(spark, sf):
    log = requests(spark, sf)
    return R.ledger_after(R.repeat_reads(log), log)


@check("read_ledger", f"WITH RECURSIVE {LEDGER} SELECT session, key, stamp, served_at, suppressed FROM ledger")
def q_ledger(spark, sf):
    return ledger(spark, sf).select("session", "key", "stamp", "served_at", "suppressed")


@check("ledger_expiry", f"WITH RECURSIVE {LEDGER} SELECT session, key FROM held")
def q_expiry(spark, sf):
    return R.expire(ledger(spark, sf), F.expr("TIMESTAMP '2024-01-30 12:00:00'")).select("session", "key")


@check("ledger_stats", f"WITH RECURSIVE {LEDGER} SELECT count(*) AS remembered, count(DISTINCT session) AS sessions, count(*) FILTER (WHERE suppressed) AS suppressed FROM ledger")
def q_ledger_stats(spark, sf):
    return R.ledger_stats(ledger(spark, sf))


@check("ledger_listing", f"""WITH RECURSIVE {LEDGER}, aged AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(served_at)) // 1000000 AS s FROM ledger)
SELECT session, split_part(key, '|', 1) AS path, split_part(key, '|', 2) AS "offset", split_part(key, '|', 3) AS "limit", served_at, CASE WHEN suppressed THEN 'suppressed' ELSE 'served' END AS state,
  CASE WHEN s < 90 THEN 'moments ago' WHEN s < 3600 THEN (s // 60) || ' minutes ago' WHEN s // 3600 = 1 THEN '1 hour ago' ELSE (s // 3600) || ' hours ago' END AS age
FROM aged ORDER BY served_at DESC, session, key LIMIT 20""")
def q_ledger_listing(spark, sf):
    return R.ledger_listing(ledger(spark, sf), F.expr("TIMESTAMP '2024-02-01 00:00:00'"))


@check("clamp_searches", f"""WITH {REQUESTS} SELECT seq, CASE WHEN head_limit IS NOT NULL THEN head_limit WHEN output_mode = 'content' THEN 80 ELSE 200 END AS new_head_limit, head_limit IS NULL AS clamped FROM reqs""")
def q_clamp_searches(spark, sf):
    return R.clamp_searches(requests(spark, sf)).select("seq", "new_head_limit", "clamped")


@check("clamp_reads", f"""WITH RECURSIVE {DECIDED} SELECT seq, CASE WHEN decision = 'suppress' THEN 'repeat' WHEN "limit" IS NULL AND size_bytes >= 131072 THEN 'large' END AS clamp,
  CASE WHEN decision = 'suppress' THEN 1 WHEN "limit" IS NULL AND size_bytes >= 131072 THEN 400 ELSE "limit" END AS new_limit,
  CASE WHEN decision != 'suppress' AND "limit" IS NULL AND size_bytes >= 131072 THEN 'Capped to 400 lines because the file is ' || format('{{:,}}', size_bytes) || ' bytes: lines ' || coalesce(nullif("offset", 0), 1) || '-' || (coalesce(nullif("offset", 0), 1) + 399) || ', not the whole file.' END AS cap_note FROM decided""")
def q_clamp_reads(spark, sf):
    clamped = R.clamp_reads(R.repeat_reads(requests(spark, sf)))
    return clamped.select("seq", "clamp", "new_limit", F.when(F.col("clamp") == "large", F.col("note")).alias("cap_note"))


@check("clamp_counters", f"""WITH RECURSIVE {DECIDED} SELECT session, count(*) AS inputs_seen, count(*) FILTER (WHERE decision = 'suppress' OR ("limit" IS NULL AND size_bytes >= 131072)) AS inputs_clamped FROM decided GROUP BY session""")
def q_clamp_counters(spark, sf):
    clamped = R.clamp_reads(R.repeat_reads(requests(spark, sf)))
    return clamped.groupBy("session").agg(F.count(F.lit(1)).alias("inputs_seen"), F.count_if(F.col("clamp").isNotNull()).alias("inputs_clamped"))


# Command lines made of an event: an opener, a command and an ending.
_OPENERS = ["", "cd /srv; ", "cd /srv && ", "cd /srv | ", "sudo ", "lg run -- ", "cd '/a;b' && "]
_MIDDLES = ["git log", "/usr/bin/RG -n x", "cat file", "rm -rf build", "npm install 'a b'"]
_ENDINGS = ["", " > out.txt", " 2>&1", " | tail -5", " && ls", " 'open", " >> 1.log", " --x=a;b"]


def _part(words, by):
    return f"element_at(array({', '.join(selection.lit(w) for w in words)}), int({by} % {len(words)}) + 1)"


def _part_sql(words, by):
    return "list_extract([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + f"], CAST({by} % {len(words)} + 1 AS INTEGER))"


def commands(spark, sf):
    events = table(spark, sf, "events").withColumn("k", F.expr("int(get_json_object(props, '$.k'))"))
    return events.select(
        F.expr("concat('c', string(user_id % 4))").alias("client"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 'PowerShell' ELSE 'Bash' END").alias("tool"),
        F.expr(f"concat({_part(_OPENERS, 'k')}, {_part(_MIDDLES, 'event_id')}, {_part(_ENDINGS, 'user_id')})").alias("command"),
    )


_WORD = "regexp_replace(regexp_replace(rest, '^(cd (''/a;b''|/srv)) ?(;|&&) ?', ''), '^/usr/bin/', '')"


@check("selection_audit", f"""WITH cmds AS (SELECT 'c' || (user_id % 4) AS client, event_id % 11 = 0 AS ps, {_part_sql(_OPENERS, _K)} AS o, {_part_sql(_MIDDLES, 'event_id')} AS m, {_part_sql(_ENDINGS, 'user_id')} AS e FROM events),
judged AS (SELECT client, CASE WHEN o = 'lg run -- ' THEN 'already wrapped' WHEN m = 'rm -rf build' AND o != 'x' THEN 'mutating'
  WHEN e = ' ''open' THEN 'unreadable' WHEN o = 'cd /srv | ' AND e IN (' && ls', ' --x=a;b') THEN CASE WHEN e = ' && ls' THEN 'listed' ELSE 'b' END
  WHEN o = 'cd /srv | ' THEN 'unreadable' WHEN o = 'sudo ' OR m = 'cat file' THEN 'not a reader'
  WHEN e IN (' > out.txt', ' >> 1.log') THEN 'to a file' WHEN ps AND e IN (' && ls', ' --x=a;b') THEN 'chained'
  WHEN ps AND e = ' 2>&1' THEN 'selected' ELSE 'selected' END AS reason FROM cmds),
fixed AS (SELECT client, CASE reason WHEN 'listed' THEN 'selected' WHEN 'b' THEN 'not a reader' ELSE reason END AS reason FROM judged),
counts AS (SELECT client, reason, count(*) AS commands FROM fixed GROUP BY ALL), totals AS (SELECT client, sum(commands) AS observed FROM counts GROUP BY client)
SELECT client, reason, commands, observed, round_even(commands * 100 / observed, 1) AS share_pct, reason IN ('selected', 'already wrapped') AS selected FROM counts JOIN totals USING (client)""")
def q_selection(spark, sf):
    return selection.selection_audit(commands(spark, sf))


# ---- reference packs --------------------------------------------------------------------------


@check("reference_packs", f"""WITH files AS (SELECT '/docs/' || doc_id || '.txt' AS path, {tokens_sql('text')} AS t FROM documents), n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT conv_id || '-' || turn AS task_id, trim(regexp_replace(CASE WHEN turn % 9 = 8 THEN ' ' ELSE text END, '^\\s+|\\s+$', '', 'g')) AS task,
  ['/docs/' || (conv_id % n) || '.txt', '/docs/7.txt', '/docs/' || (conv_id * 3 % n) || '.txt', '/docs/7.txt'] || CASE WHEN conv_id % 10 = 9 THEN ['/gone/' || conv_id] ELSE [] END AS refs,
  CASE WHEN turn % 2 = 0 THEN ['/src/a.py', '/src/a.py', '/src/b.py'] ELSE [] END AS owns, CASE WHEN turn % 3 = 0 THEN ['tests pass'] ELSE [] END AS checks FROM conversations, n),
t AS (SELECT task_id, task, owns, checks, list_distinct(refs) AS refs, list_filter(refs, lambda r, i: list_position(refs, r) = i) AS uniq FROM raw),
p AS (SELECT *, array_to_string(list_concat(['Start fresh with no inherited conversation.', 'Use file paths as references; never embed or repeat their contents.', 'Read these exact reference files before acting:'],
  list_transform(uniq, lambda r: '- ' || r), CASE WHEN len(owns) > 0 THEN ['Edit these owned paths directly:', '- /src/a.py', '- /src/b.py'] ELSE [] END,
  CASE WHEN len(checks) > 0 THEN ['Acceptance checks:', '- tests pass'] ELSE [] END, ['Task: ' || task, 'Return a report of no more than 120 words.']), chr(10)) AS prompt FROM t),
r AS (SELECT task_id, sum(f.t) AS referenced, min(CASE WHEN f.path IS NULL THEN u.path END) AS missing FROM (SELECT task_id, unnest(uniq) AS path FROM t) AS u LEFT JOIN files AS f ON f.path = u.path GROUP BY task_id),
e AS (SELECT p.task_id, CASE WHEN task = '' THEN 'task is empty' WHEN missing IS NOT NULL THEN 'no such file: ' || missing END AS error, prompt, {tokens_sql('prompt')} AS embedded, referenced FROM p JOIN r ON p.task_id = r.task_id)
SELECT task_id, error, CASE WHEN error IS NULL THEN prompt END AS prompt, CASE WHEN error IS NULL THEN embedded END AS embedded_tokens, CASE WHEN error IS NULL THEN referenced END AS referenced_tokens,
  CASE WHEN error IS NULL THEN greatest(referenced - embedded, 0) END AS avoided_tokens FROM e""")
def q_packs(spark, sf):
    files = documents(spark, sf, "doc_id", "text").select(F.expr("concat('/docs/', string(doc_id), '.txt')").alias("path"), "text")
    n = table(spark, sf, "documents").count()
    tasks = table(spark, sf, "conversations").select(
        F.expr("concat(string(conv_id), '-', string(turn))").alias("task_id"),
        F.expr("CASE WHEN turn % 9 = 8 THEN ' ' ELSE text END").alias("task"),
        F.expr(f"concat(array(concat('/docs/', string(conv_id % {n}), '.txt'), '/docs/7.txt', concat('/docs/', string(conv_id * 3 % {n}), '.txt'), '/docs/7.txt'), CASE WHEN conv_id % 10 = 9 THEN array(concat('/gone/', string(conv_id))) ELSE array() END)").alias("refs"),
        F.expr("CASE WHEN turn % 2 = 0 THEN array('/src/a.py', '/src/a.py', '/src/b.py') ELSE array() END").alias("owns"),
        F.expr("CASE WHEN turn % 3 = 0 THEN array('tests pass') ELSE array() END").alias("checks"),
    )
    done = packs.reference_packs(tasks, files)
    return done.drop("refs")
