"""Routing, rules, filters and the pipeline. The oracle applies every rule to a table of lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import LINES, METRICS, MIXED_LINES, STORE, mixed_outputs, outputs, store, tokens_sql
from checks.registry import check
from checks.text import fp_sql
from logsift.functions import text as T
from logsift.operators import search
from logsift.operators import store as S
from logsift.options import Options
from logsift.plans import reports
from logsift.plans.filters import BUILTIN_FILTERS, apply_filter, filter_name
from logsift.plans.compression import compress, footer, render
from logsift.plans.rules import BUILTIN_RULES, Rule, matches, rule
from logsift.scratch import new_path, saved


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _on(match: str) -> str:
    return f"regexp_matches(command, {_q('(?i)' + match)})"


class LineSql:
    """Grows a chain of CTEs over ``lines(id, command, n, line)``, one per action."""

    def __init__(self, mixed: bool = False):
        self.mixed = mixed
        self.ctes = [
            MIXED_LINES if mixed else LINES,
            "l0 AS MATERIALIZED (SELECT id, command, n, CASE WHEN n = 0 THEN ltrim(line, chr(65279)) ELSE line END AS line FROM lines)",
        ]
        self.now, self.count, self.marks = "l0", 0, []

    def add(self, body: str) -> None:
        """``body`` selects id, command, n, sub, line from ``{src}``; lines are numbered again."""
        self.count += 1
        name = f"l{self.count}"
        self.ctes.append(
            f"{name} AS MATERIALIZED (SELECT id, command, row_number() OVER (PARTITION BY id ORDER BY n, sub) - 1 AS n, line "
            f"FROM ({body.replace("{src}", self.now)}) AS t)"
        )
        self.now = name

    def keep_one_line(self, before: str) -> None:
        """An output that lost all its lines is one empty line."""
        self.add(
            "SELECT id, command, n, 0 AS sub, line FROM {src} UNION ALL "
            f"SELECT DISTINCT id, command, 0, 0, '' FROM {before} WHERE id NOT IN (SELECT id FROM {{src}})"
        )

    def drop(self, on: str, where: str) -> None:
        before = self.now
        self.add(f"SELECT id, command, n, 0 AS sub, line FROM {{src}} WHERE NOT (({on}) AND ({where}))")
        self.keep_one_line(before)

    def rewrite(self, on: str, new: str) -> None:
        self.add(f"SELECT id, command, n, 0 AS sub, CASE WHEN {on} THEN {new} ELSE line END AS line FROM {{src}}")

    def collapse(self, on: str, least: int) -> None:
        self.add(
            f"SELECT id, command, n, 0 AS sub, CASE WHEN ({on}) AND c >= {least} AND r = 2 THEN '    … ⟨×' || c || ' similar lines⟩' ELSE line END AS line FROM ("
            "SELECT *, count(*) OVER (PARTITION BY id, g) AS c, row_number() OVER (PARTITION BY id, g ORDER BY n) AS r FROM ("
            "SELECT *, sum(chg) OVER (PARTITION BY id ORDER BY n) AS g FROM ("
            "SELECT *, CASE WHEN fp = '' OR fp IS DISTINCT FROM lag(fp) OVER (PARTITION BY id ORDER BY n) THEN 1 ELSE 0 END AS chg FROM ("
            f"SELECT *, CASE WHEN {on} THEN {fp_sql('line')} ELSE '' END AS fp FROM {{src}}) AS a) AS b) AS c) AS d WHERE NOT (({on}) AND c >= {least} AND r > 2)"
        )

    def cap(self, on: str, key: str, most: int, marker: str) -> None:
        self.add(
            f"SELECT id, command, n, 0 AS sub, CASE WHEN k IS NOT NULL AND c > {most} AND r = {most + 1} THEN {marker} ELSE line END AS line FROM ("
            "SELECT *, count(*) OVER (PARTITION BY id, k) AS c, row_number() OVER (PARTITION BY id, k ORDER BY n) AS r FROM ("
            f"SELECT *, CASE WHEN {on} THEN nullif({key}, '') END AS k FROM {{src}}) AS a) AS b WHERE k IS NULL OR r <= {most + 1}"
        )

    def ends(self, on: str, head: int, tail: int, label: str) -> None:
        sized = "(SELECT *, count(*) OVER (PARTITION BY id) AS c FROM {src})"
        self.add(
            f"SELECT id, command, n, 0 AS sub, line FROM {sized} AS a WHERE NOT ({on}) OR c <= {head + tail + 1} OR n < {head} OR n >= c - {tail} "
            f"UNION ALL SELECT DISTINCT id, command, {head}, 1, '… ⟨' || (c - {head + tail}) || ' {label} hidden⟩' FROM {sized} AS b WHERE ({on}) AND c > {head + tail + 1}"
        )

    def drop_and_count(self, on: str, noise: str, what: str) -> None:
        self.add(
            f"SELECT id, command, n, 0 AS sub, line FROM {{src}} WHERE NOT (({on}) AND ({noise})) UNION ALL "
            f"SELECT id, command, max(n), 1, '… ⟨' || count(*) FILTER (WHERE {noise}) || ' {what} hidden⟩' FROM {{src}} "
            f"WHERE {on} GROUP BY id, command HAVING count(*) FILTER (WHERE {noise}) > 0"
        )

    def mark(self, name: str, before: str) -> None:
        """Note the outputs whose text differs from CTE ``before``."""
        text = lambda cte: f"(SELECT id, string_agg(line, chr(10) ORDER BY n) AS t FROM {cte} GROUP BY id)"
        k = len(self.marks)
        self.ctes.append(
            f"m{k} AS MATERIALIZED (SELECT a.id, {k} AS k, {_q(name)} AS name FROM {text(before)} AS a JOIN {text(self.now)} AS b ON a.id = b.id WHERE a.t != b.t)"
        )
        self.marks.append(f"m{k}")

    def filters(self) -> None:
        """The built-in filters; an output belongs to the first that matches."""
        earlier: list[str] = []
        for f in BUILTIN_FILTERS:
            on = " AND ".join([_on(f.match)] + [f"NOT {e}" for e in earlier])
            earlier.append(_on(f.match))
            before = self.now
            if f.name == "git-status":
                self.drop(on, r"regexp_matches(line, '^\s*\(use ')")
                mid = self.now
                self.add(
                    f"SELECT id, command, n, 0 AS sub, line FROM (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY n) AS p FROM {mid}) AS a "
                    f"WHERE NOT (({on}) AND trim(line) = '' AND trim(p) IS NOT DISTINCT FROM '')"
                )
                self.ends(on, 40, 20, "status lines")
            elif f.name == "pip-install":
                noise = (
                    r"regexp_matches(line, '(?i)^(Requirement already satisfied|\s*(Downloading|Using cached|Collecting|Obtaining|Getting|Preparing metadata"
                    r"|Building wheel|Created wheel|Stored in directory|WARNING: ))') AND NOT contains(lower(line), 'error')"
                )
                self.drop_and_count(on, noise, "pip progress lines")
            elif f.name == "npm-install":
                self.drop_and_count(on, r"regexp_matches(lower(trim(line)), '^(npm warn|npm notice|warning |warning:)')", "npm warn/notice lines")
            elif f.name == "pytest":
                self.drop(on, r"regexp_matches(line, '^[\s.sFExXpP]+\[\s*\d+%\]\s*$')")
            else:
                self.ends(on, 40, 20, "entries")
            self.mark(f.name, before)

    def rules(self, rules: list[Rule]) -> None:
        stopped: list[str] = []
        for r in rules:
            on = " AND ".join([_on(r.match)] + [f"NOT {s}" for s in stopped])
            if r.stop:
                stopped.append(_on(r.match))
            before = self.now
            for kind, arg in r.actions:
                if kind == "strip_ansi":
                    self.rewrite(on, r"regexp_replace(line, '\x1b\[[0-9;]*[A-Za-z]', '', 'g')")
                elif kind == "max_line_len":
                    body = r"regexp_replace(line, '… ⟨\+\d+ chars⟩$', '')"
                    was = r"coalesce(try_cast(regexp_extract(line, '… ⟨\+(\d+) chars⟩$', 1) AS BIGINT), 0)"
                    self.rewrite(on, f"CASE WHEN length({body}) <= {arg} THEN line ELSE left({body}, {arg}) || '… ⟨+' || (length({body}) - {arg} + {was}) || ' chars⟩' END")
                elif kind == "drop_lines":
                    self.drop(on, f"regexp_matches(line, {_q(arg)})")
                elif kind == "keep_lines":
                    self.drop(on, f"NOT regexp_matches(line, {_q(arg)})")
                elif kind == "collapse_repeats":
                    self.collapse(on, arg)
                elif kind == "cascade_guard":
                    self.cap(on, fp_sql("line"), arg, f"'    … ⟨and ' || (c - {arg}) || ' more like this⟩'")
                elif kind == "limit_per_file":
                    self.cap(on, r"regexp_extract(line, '^([^\s:][^:]*):\d+:', 1)", arg, f"'    … ⟨+' || (c - {arg}) || ' more in ' || k || '⟩'")
                elif kind == "keep_head_tail":
                    self.ends(on, arg[0], arg[1], "lines")
                elif kind == "replace":
                    self.rewrite(on, f"regexp_replace(line, {_q(arg[0])}, {_q(arg[1])}, 'g')")
                elif kind == "summary":
                    # The only summary used here counts replaced numbers: one per stand-in of this rule.
                    self.add(
                        f"SELECT id, command, n, 0 AS sub, line FROM {{src}} UNION ALL "
                        f"SELECT a.id, a.command, max(a.n), 1, 'hid ' || (SELECT count(*) FROM {before} AS b WHERE b.id = a.id AND regexp_matches(b.line, '^step 1')) || ' lines' FROM {{src}} AS a WHERE {on.replace('command', 'a.command')} GROUP BY a.id, a.command"
                    )
            self.mark(r.name, before)

    def shown(self) -> str:
        """Body and label before the valve. A JSON document gets its view if that is shorter, and no line work."""
        js, body, label = "false", "b.body", "coalesce(x.label, 'none')"
        if self.mixed:
            js = "(o.id % 11 = 3 AND length(v.view) < length(ltrim(o.raw, chr(65279))))"
            body, label = f"CASE WHEN {js} THEN v.view ELSE b.body END", f"CASE WHEN {js} THEN 'json' ELSE {label} END"
        views = "JOIN views AS v ON v.id = o.id" if self.mixed else ""
        return f"SELECT o.*, {body} AS body, {label} AS label FROM outputs AS o JOIN bodies AS b ON o.id = b.id {views} LEFT JOIN names AS x ON x.id = o.id"

    def results(self) -> str:
        """CTEs up to ``results``: the row each output gets from the pipeline."""
        marks = " UNION ALL ".join(f"SELECT * FROM {m}" for m in self.marks)
        done = f"""bodies AS MATERIALIZED (SELECT id, string_agg(line, chr(10) ORDER BY n) AS body FROM {self.now} GROUP BY id),
names AS (SELECT id, string_agg(name, '+' ORDER BY k) AS label FROM ({marks}) AS m GROUP BY id),
shown AS MATERIALIZED ({self.shown()}),
judged AS MATERIALIZED (SELECT *, {tokens_sql('raw')} AS raw_tokens, {tokens_sql('body')} AS after FROM shown),
valve AS (SELECT *, raw_tokens < 40 OR body = raw OR (raw_tokens - after) / raw_tokens < 0.15 AS passthrough FROM judged),
results AS MATERIALIZED (SELECT id, ts, command, cwd, exit_code, raw, raw_tokens, passthrough, CASE WHEN passthrough THEN raw ELSE body END AS body,
  CASE WHEN passthrough THEN raw_tokens ELSE after END AS comp_tokens, CASE WHEN passthrough THEN 'passthrough' ELSE label END AS label FROM valve)"""
        return "WITH " + ",\n".join([*self.ctes, done]) + "\n"


def pipeline_sql(rules: list[Rule] = BUILTIN_RULES, mixed: bool = False) -> str:
    sql = LineSql(mixed)
    sql.filters()
    sql.rules(rules)
    return sql.results()


NOISY = pipeline_sql()
RESULTS = pipeline_sql(mixed=True)


def results(spark, sf):
    return compress(mixed_outputs(spark, sf))


@check("compress_mixed", RESULTS + "SELECT id, label, raw_tokens, comp_tokens, raw_tokens - comp_tokens AS saved, passthrough, md5(body) AS body FROM results")
def q_compress_mixed(spark, sf):
    """Text, JSON and text that only begins like JSON."""
    return results(spark, sf).select("id", "label", "raw_tokens", "comp_tokens", "saved", "passthrough", F.md5("body").alias("body"))


@check("compress_outputs", NOISY + "SELECT id, label, raw_tokens, comp_tokens, raw_tokens - comp_tokens AS saved, passthrough, md5(body) AS body FROM results")
def q_compress(spark, sf):
    done = compress(outputs(spark, sf))
    return done.select("id", "label", "raw_tokens", "comp_tokens", "saved", "passthrough", F.md5("body").alias("body"))


@check("builtin_filters", (lambda s: (s.filters(), s.results())[1])(LineSql()) + "SELECT o.id, coalesce(x.label, 'none') AS filter, md5(b.body) AS body FROM outputs AS o JOIN bodies AS b ON o.id = b.id LEFT JOIN names AS x ON x.id = o.id")
def q_filters(spark, sf):
    lines = outputs(spark, sf).select("id", F.expr(filter_name("command")).alias("f"), F.expr(T.split_lines(T.strip_bom("raw"))).alias("lines"))
    done = lines.withColumn("new", F.expr(T.let("lines", lambda ls: apply_filter(ls, "f"))))
    name = F.when(F.col("new") != F.col("lines"), F.col("f")).otherwise("none")
    return done.select("id", name.alias("filter"), F.md5(F.expr(T.join_lines("new"))).alias("body"))


def _routes_sql() -> str:
    filters = " ".join(f"WHEN {_on(f.match)} THEN {_q(f.name)}" for f in BUILTIN_FILTERS)
    rules = ", ".join(f"CASE WHEN {_on(r.match)} THEN {_q(r.name)} END" for r in BUILTIN_RULES)
    return f"""WITH {LINES}, cmds AS (SELECT command, count(*) AS outputs FROM outputs GROUP BY command)
SELECT command, outputs, CASE {filters} END AS filter, array_to_string(list_filter([{rules}], lambda r: r IS NOT NULL), ', ') AS rules FROM cmds"""


@check("route_commands", _routes_sql())
def q_routes(spark, sf):
    """Which filter and rules each command would get, and how many outputs it has."""
    commands = outputs(spark, sf).groupBy("command").agg(F.count(F.lit(1)).alias("outputs"))
    named = ", ".join(f"CASE WHEN {matches(r, 'command')} THEN {T.lit(r.name)} END" for r in BUILTIN_RULES)
    return commands.select(
        "command", "outputs", F.expr(filter_name("command")).alias("filter"), F.expr(f"array_join(array({named}), ', ')").alias("rules")
    )


@check("rule_matches", f"WITH {LINES}, names AS (SELECT unnest([{', '.join(_q(r.name) for r in BUILTIN_RULES)}]) AS name, unnest([{', '.join(_q(r.match) for r in BUILTIN_RULES)}]) AS match) SELECT name, match, count(o.id) AS outputs FROM names LEFT JOIN outputs AS o ON regexp_matches(o.command, '(?i)' || match) GROUP BY ALL")
def q_rule_matches(spark, sf):
    """The rule list with the number of outputs each rule is for: one pass, one counter per rule."""
    counts = outputs(spark, sf).agg(*[F.count_if(F.expr(matches(r, "command"))).alias(f"r{i}") for i, r in enumerate(BUILTIN_RULES)])
    each = ", ".join(f"named_struct('name', {T.lit(r.name)}, 'match', {T.lit(r.match)}, 'outputs', r{i})" for i, r in enumerate(BUILTIN_RULES))
    return counts.select(F.expr(f"inline(array({each}))"))


USER_RULES = [
    *BUILTIN_RULES[:2],
    rule("mask", "git|docker", ("drop_lines", "^step 1"), ("replace", ["[0-9]+", "N"]), ("summary", "hid {dropped} lines")),
    rule("only-steps", "cargo", ("keep_lines", "step"), stop=True),
    rule("late", "cargo|git", ("limit_per_file", 2), ("keep_head_tail", [3, 2])),
]


@check("user_rules", pipeline_sql(USER_RULES, mixed=True) + "SELECT id, label, raw_tokens, comp_tokens, md5(body) AS body FROM results")
def q_user_rules(spark, sf):
    done = compress(mixed_outputs(spark, sf), rules=USER_RULES)
    return done.select("id", "label", "raw_tokens", "comp_tokens", F.md5("body").alias("body"))


PATTERN_RULES = [
    rule("odd-classes", "^[[a-d]", ("drop_lines", "^[[]"), ("drop_lines", "^#x{,3}[0-9]"), ("replace", ["[a&&b]{2,}", "<>"])),
    rule("only-python", "(?P<a>x)?(?(a)y|.)", ("keep_lines", "^nothing$")),
    rule("half", "^g", ("keep_lines", "(?P<a>x)?(?(a)y|.)"), ("replace", ["(?P<n_1>t)(?P=n_1)", r"\g<n_1>{"]), ("drop_lines", "}{,2}$x")),
]


@check("user_patterns", f"""WITH {MIXED_LINES}, l0 AS (SELECT id, n, CASE WHEN n = 0 THEN ltrim(line, chr(65279)) ELSE line END AS line,
  regexp_matches(command, '^[a-d\\[]') AS odd, command ILIKE 'g%' AS half FROM lines),
kept AS (SELECT id, n, CASE WHEN odd THEN regexp_replace(line, '[ab&][ab&]+', '<>', 'g') WHEN half THEN replace(line, 'tt', 't{{') ELSE line END AS line
  FROM l0 WHERE NOT (odd AND (line LIKE '[%' OR regexp_matches(line, '^#(|x|xx|xxx)[0-9]')))),
bodies AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS body FROM (SELECT DISTINCT id FROM l0) AS ids LEFT JOIN kept USING (id) GROUP BY id)
SELECT o.id, md5(CASE WHEN o.id % 11 = 3 AND length(v.view) < length(ltrim(o.raw, chr(65279))) THEN v.view ELSE b.body END) AS body
FROM outputs AS o JOIN views AS v USING (id) JOIN bodies AS b ON b.id = o.id""")
def q_user_patterns(spark, sf):
    """Patterns that are valid in Python's dialect and mean something else, or nothing, in Java's."""
    done = compress(mixed_outputs(spark, sf), Options(min_tokens=0, min_saving=-100), rules=PATTERN_RULES, filters=[])
    return done.select("id", F.md5("body").alias("body"))


HANDLE = "left(sha256(id || chr(10) || raw), 24)"
FOOTER = f"""CASE WHEN passthrough THEN '⟨sifted: passthrough (' || raw_tokens || ' tok)⟩' ELSE '⟨sifted ' || label || ': ' || raw_tokens || '→' || comp_tokens ||
  ' tok, saved ' || CAST(round_even((raw_tokens - comp_tokens) / raw_tokens * 100, 0) AS BIGINT) || '% · full: lg recall ' || {HANDLE} || '⟩' END"""


@check("footers", RESULTS + f"SELECT id, {FOOTER} AS footer, length(CASE WHEN passthrough THEN body ELSE body || chr(10) || {FOOTER} END) AS shown FROM results")
def q_footers(spark, sf):
    done = results(spark, sf)
    return done.select("id", footer(done).alias("footer"), F.length(render(done)).cast("bigint").alias("shown"))


LIFETIME = """life AS (SELECT count(*) AS outputs_seen, count(*) FILTER (WHERE NOT passthrough) AS outputs_compressed, count(*) FILTER (WHERE passthrough) AS outputs_passthrough,
  coalesce(sum(raw_tokens) FILTER (WHERE NOT passthrough), 0) AS raw_tokens, coalesce(sum(comp_tokens) FILTER (WHERE NOT passthrough), 0) AS out_tokens,
  coalesce(sum(raw_tokens) FILTER (WHERE passthrough), 0) AS passthrough_tokens, coalesce(max(raw_tokens - comp_tokens), 0) AS largest_single_saving,
  min(ts) AS first_seen, max(ts) AS last_seen FROM {0})
SELECT outputs_seen, outputs_compressed, outputs_passthrough, raw_tokens, out_tokens, passthrough_tokens, raw_tokens - out_tokens AS tokens_saved,
  round_even((raw_tokens - out_tokens) * 100 / raw_tokens, 1) AS reduction_on_compressed_pct,
  round_even((raw_tokens - out_tokens) * 100 / (raw_tokens + passthrough_tokens), 1) AS reduction_overall_pct,
  largest_single_saving, round_even(largest_single_saving * 100 / (raw_tokens - out_tokens), 1) AS largest_share_pct, first_seen, last_seen FROM life"""


@check("savings_lifetime", RESULTS.rstrip() + ", " + LIFETIME.format("results"))
def q_lifetime(spark, sf):
    return reports.savings_lifetime(results(spark, sf))


BY_LABEL = """SELECT label, count(*) AS outputs, sum(raw_tokens - comp_tokens) AS tokens_saved,
  round_even(sum(raw_tokens - comp_tokens) * 100 / sum(raw_tokens), 1) AS reduction_pct FROM {0} WHERE NOT passthrough GROUP BY label"""


@check("savings_by_label", RESULTS + BY_LABEL.format("results"))
def q_by_label(spark, sf):
    return reports.savings_by_label(results(spark, sf))


@check("savings_top_labels", RESULTS + BY_LABEL.format("results") + " ORDER BY tokens_saved DESC, label LIMIT 6")
def q_top_labels(spark, sf):
    return reports.savings_by_label(results(spark, sf), 6)


@check("recall_rows", RESULTS + f"SELECT CAST(id AS VARCHAR) AS id, ts, command, cwd, exit_code, md5(raw) AS raw, raw_tokens, comp_tokens, label AS filt, CAST(ts AS DATE) AS day, strlen(raw) AS bytes, {HANDLE} AS handle FROM results WHERE NOT passthrough")
def q_recall_rows(spark, sf):
    """Rows the recall table takes, with handles of the length that footers show."""
    rows = S.store_rows(results(spark, sf)).withColumn("raw", F.md5("raw"))
    return S.with_handles(rows, shortest=24).drop("name")


@check("run_efficiency", RESULTS.rstrip() + f""", shown AS (SELECT *, CASE WHEN passthrough THEN body ELSE body || chr(10) || {FOOTER} END AS s FROM results),
runs AS (SELECT *, {tokens_sql('s')} AS output_tokens FROM shown)
SELECT count(*) AS runs, count(*) FILTER (WHERE NOT passthrough) AS compressed, sum(raw_tokens) AS tokens_in, sum(output_tokens) AS tokens_out FROM runs""")
def q_run_efficiency(spark, sf):
    """Runtime counters of the pipeline itself; the tokens that left include the footers."""
    done = results(spark, sf).withColumn("client", F.lit("local")).withColumn("process_ns", F.lit(0).cast("bigint"))
    report = reports.runtime_efficiency(reports.run_events(done))
    return report.filter("client = 'local'").select("runs", "compressed", "tokens_in", "tokens_out")


EFFICIENCY = METRICS + """, clients AS (SELECT unnest(['codex', 'claude', 'gemini', 'local']) AS client),
sums AS (SELECT client, count(*) FILTER (WHERE kind = 'observe') AS observed, count(*) FILTER (WHERE kind = 'observe' AND flag) AS auto_selected,
  count(*) FILTER (WHERE kind = 'input') AS inputs_seen, count(*) FILTER (WHERE kind = 'input' AND flag) AS inputs_clamped,
  count(*) FILTER (WHERE kind = 'run') AS runs, count(*) FILTER (WHERE kind = 'run' AND flag) AS compressed,
  sum(raw_tokens) FILTER (WHERE kind = 'run') AS tokens_in, sum(output_tokens) FILTER (WHERE kind = 'run') AS tokens_out,
  sum(process_ns) FILTER (WHERE kind = 'run') AS ns, max(ts) AS updated_at FROM metrics GROUP BY client)
SELECT client, observed, auto_selected, round_even(auto_selected * 100 / observed, 1) AS selection_pct, inputs_seen, inputs_clamped,
  round_even(inputs_clamped * 100 / inputs_seen, 1) AS inputs_clamped_pct, runs, compressed, runs - compressed AS passthrough, tokens_in, tokens_out,
  tokens_in - tokens_out AS tokens_saved, round_even((tokens_in - tokens_out) * 100 / tokens_in, 1) AS reduction_pct,
  round_even(ns / runs / 1e6, 3) AS average_process_ms, updated_at FROM clients LEFT JOIN sums USING (client)"""


@check("runtime_efficiency", "WITH " + EFFICIENCY)
def q_efficiency(spark, sf):
    from checks.inputs import metric_events

    return reports.runtime_efficiency(metric_events(spark, sf))


@check("efficiency_listing", f"""WITH e AS (WITH {EFFICIENCY}) SELECT client, observed || '/' || auto_selected AS seen_auto, runs, compressed,
  format('{{:,}}', CAST(tokens_in AS BIGINT)) || '→' || format('{{:,}}', CAST(tokens_out AS BIGINT)) AS tokens, reduction_pct, inputs_clamped || '/' || inputs_seen AS clamped,
  strftime(updated_at, '%Y-%m-%d') AS last_update FROM e""")
def q_efficiency_listing(spark, sf):
    from checks.inputs import metric_events

    return reports.efficiency_listing(reports.runtime_efficiency(metric_events(spark, sf)))


@check("report_json", METRICS.join(["WITH ", ""]) + """ SELECT to_json({client: client, events: count(*), runs: count(*) FILTER (WHERE kind = 'run')}) AS value FROM metrics GROUP BY client""")
def q_report_json(spark, sf):
    from checks.inputs import metric_events
    from logsift.functions.labels import client_label

    counted = metric_events(spark, sf).groupBy(client_label(F.col("client")).alias("client")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("kind") == "run").alias("runs")
    )
    return reports.as_json(counted)


@check("store_totals", f"WITH {STORE} SELECT count(*) AS outputs_held, sum(raw_tokens) AS tokens_in, sum(comp_tokens) AS tokens_out, sum(raw_tokens - comp_tokens) AS tokens_saved, round_even(sum(raw_tokens - comp_tokens) * 100 / sum(raw_tokens), 1) AS reduction_pct FROM store")
def q_store_totals(spark, sf):
    return S.totals(store(spark, sf))


@check("gain_history", f"WITH {STORE} SELECT id, round_even((raw_tokens - comp_tokens) * 100 / raw_tokens, 0) AS saved_pct, raw_tokens, comp_tokens, filt, left(command, 40) AS command FROM store ORDER BY ts DESC, id LIMIT 10")
def q_history(spark, sf):
    return reports.history(store(spark, sf), 10)


@check("store_by_day", RESULTS + "SELECT CAST(ts AS DATE) AS day, count(*) AS outputs, sum(raw_tokens) AS raw_tokens, sum(strlen(raw)) AS bytes FROM results WHERE NOT passthrough GROUP BY ALL")
def q_store_by_day(spark, sf):
    """The recall table written by day and read back."""
    path = new_path(spark, "store")
    S.write_store(S.store_rows(results(spark, sf)), path)
    held = S.read_store(spark, path).groupBy("day")
    return held.agg(F.count(F.lit(1)).alias("outputs"), F.sum("raw_tokens").alias("raw_tokens"), F.sum(F.octet_length("raw")).alias("bytes"))


def _written(spark, sf):
    path = new_path(spark, "store")
    S.write_store(S.store_rows(results(spark, sf)), path)
    return path


@check("recall_written", RESULTS + f"SELECT CAST(id AS VARCHAR) AS id, CAST(ts AS DATE) AS day, md5(raw) AS raw FROM results WHERE NOT passthrough AND {HANDLE} LIKE (SELECT left({HANDLE}, 6) FROM results WHERE NOT passthrough ORDER BY id LIMIT 1) || '%'")
def q_recall_written(spark, sf):
    """A handle in the store on disk: its days come from the table of names."""
    path = _written(spark, sf)
    S.write_names(spark, path)
    first = S.read_store(spark, path).orderBy(F.col("id").cast("long")).select("name").first()
    return S.recall_in(spark, path, first.name[:6]).select("id", "day", F.md5("raw").alias("raw"))


@check("cap_store", RESULTS + """, held AS (SELECT *, row_number() OVER (ORDER BY ts DESC) AS place FROM results WHERE NOT passthrough),
newest AS (SELECT *, sum(strlen(raw)) OVER (ORDER BY ts DESC) AS upto, (SELECT sum(strlen(raw)) // 3 FROM held) AS room FROM held WHERE place <= (SELECT count(*) * 2 // 3 FROM held))
SELECT CAST(id AS VARCHAR) AS id, CAST(ts AS DATE) AS day, md5(raw) AS raw FROM newest WHERE upto <= room""")
def q_cap_store(spark, sf):
    """The store on disk after both caps have deleted from it, read back."""
    path = _written(spark, sf)
    held = S.read_store(spark, path).agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).first()
    S.prune_store(spark, path, Options(max_store_rows=held.n * 2 // 3, max_store_bytes=held.bytes // 3))
    return S.read_store(spark, path).select("id", "day", F.md5("raw").alias("raw"))


@check("search_pruned", RESULTS + "SELECT CAST(id AS VARCHAR) AS id, ts, md5(raw) AS raw FROM results WHERE NOT passthrough AND (lower(raw) LIKE '%step 7%finished in 6ms%' OR lower(command) LIKE '%step 7%finished in 6ms%') ORDER BY ts DESC, results.id LIMIT 10")
def q_search_pruned(spark, sf):
    """Substring search in the store on disk; files without the trigrams of the text are left unread."""
    path = _written(spark, sf)
    search.write_signatures(S.read_store(spark, path), path)
    return search.search_like_in(spark, path, "Step 7%finished in 6ms").select("id", "ts", F.md5("raw").alias("raw"))


@check("gain_report", RESULTS + """SELECT 'lifetime' AS section, NULL AS label, count(*) AS outputs, sum(raw_tokens - comp_tokens) AS tokens_saved FROM results
UNION ALL SELECT * FROM (SELECT 'label', label, count(*), sum(raw_tokens - comp_tokens) AS s FROM results WHERE NOT passthrough GROUP BY label ORDER BY s DESC, label LIMIT 6)
UNION ALL SELECT 'store', NULL, count(*), sum(raw_tokens - comp_tokens) FROM results WHERE NOT passthrough""")
def q_gain(spark, sf):
    """Lifetime, labels and store side by side, from one written table of results."""
    done = saved(results(spark, sf).select("id", "ts", "command", "raw_tokens", "comp_tokens", "label", "passthrough", F.col("label").alias("filt")), "results")
    parts = reports.gain_report(done, done.filter(~F.col("passthrough")))
    none = F.lit(None).cast("string").alias("label")
    life = parts["lifetime"].select(F.lit("lifetime").alias("section"), none, F.col("outputs_seen").alias("outputs"), "tokens_saved")
    labels = parts["by_label"].select(F.lit("label").alias("section"), "label", "outputs", "tokens_saved")
    held = parts["store"].select(F.lit("store").alias("section"), none, F.col("outputs_held").alias("outputs"), "tokens_saved")
    return life.unionByName(labels).unionByName(held)
