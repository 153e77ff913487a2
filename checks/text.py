"""Lines, folds and scalar functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import LINES, OUTPUTS, lines_as_items, outputs, table, tokens_sql
from checks.registry import check
from logsift.functions import text as T
from logsift.functions.text import VOLATILE
from logsift.operators import folds
from logsift.operators.lines import hits_per_file, rejoined, to_lines


def fp_sql(line: str) -> str:
    out = f"rtrim({line}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    for pattern, stand_in in VOLATILE:
        out = f"regexp_replace({out}, '{pattern}', '{stand_in}', 'g')"
    return f"trim({out}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160))"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


FPS = f"{LINES}, fps AS MATERIALIZED (SELECT *, {fp_sql('line')} AS fp FROM lines)"


def _folded(name: str) -> str:
    """Digest of the rebuilt lines (id, n, sub, line) of CTE ``name``."""
    return f"SELECT id, md5(string_agg(line, chr(10) ORDER BY n, sub)) AS body, count(*) AS lines FROM {name} GROUP BY id"


def _every(name: str) -> str:
    """The same for all outputs, those without a line left included."""
    return f"SELECT o.id, md5(coalesce(string_agg(line, chr(10) ORDER BY n, sub), '')) AS body, count(k.n) AS lines FROM outputs AS o LEFT JOIN {name} AS k ON k.id = o.id GROUP BY o.id"


def _digest(spark, sf, fold):
    items = lines_as_items(spark, sf).withColumn("items", F.expr(fold))
    kept = items.selectExpr("id", "transform(items, x -> x.line) AS kept") if "line" in items.schema["items"].dataType.elementType.simpleString() else items.selectExpr("id", "items AS kept")
    return kept.select("id", F.md5(F.expr(T.join_lines("kept"))).alias("body"), F.size("kept").cast("bigint").alias("lines"))


@check("to_lines", _with(LINES) + "SELECT id, n, line FROM lines")
def q_to_lines(spark, sf):
    return to_lines(outputs(spark, sf).select("id", "raw")).select("id", "n", "line")


@check("from_lines", _with(OUTPUTS) + "SELECT id, md5(raw) AS body FROM outputs")
def q_from_lines(spark, sf):
    return outputs(spark, sf).select("id", F.md5(F.expr(rejoined("raw"))).alias("body"))


@check("strip_bom", _with(OUTPUTS) + "SELECT id, length(ltrim(raw, chr(65279))) AS chars, md5(ltrim(raw, chr(65279))) AS body FROM outputs")
def q_strip_bom(spark, sf):
    view = F.expr(T.strip_bom("raw"))
    return outputs(spark, sf).select("id", F.length(view).cast("bigint").alias("chars"), F.md5(view).alias("body"))


@check("strip_ansi", _with(OUTPUTS) + r"SELECT id, md5(regexp_replace(raw, '\x1b\[[0-9;]*[A-Za-z]', '', 'g')) AS body FROM outputs")
def q_strip_ansi(spark, sf):
    return outputs(spark, sf).select("id", F.md5(F.expr(T.strip_ansi("raw"))).alias("body"))


@check("drop_lines", _with(LINES, "kept AS (SELECT *, 0 AS sub FROM lines WHERE NOT regexp_matches(line, '^step [0-9]+'))") + _folded("kept"))
def q_drop_lines(spark, sf):
    return _digest(spark, sf, folds.keep_where("lines", folds.Plain, lambda l: f"NOT {T.search(l, '^step [0-9]+')}"))


@check("keep_lines", _with(LINES, "kept AS (SELECT *, 0 AS sub FROM lines WHERE regexp_matches(line, '[0-9]'))") + _every("kept"))
def q_keep_lines(spark, sf):
    return _digest(spark, sf, folds.keep_where("lines", folds.Plain, lambda l: T.search(l, "[0-9]")))


_clip = lambda line, n: f"""CASE WHEN length(regexp_replace({line}, '… ⟨\\+\\d+ chars⟩$', '')) <= {n} THEN {line}
  ELSE left(regexp_replace({line}, '… ⟨\\+\\d+ chars⟩$', ''), {n}) || '… ⟨+' ||
    (length(regexp_replace({line}, '… ⟨\\+\\d+ chars⟩$', '')) - {n} + coalesce(try_cast(regexp_extract({line}, '… ⟨\\+(\\d+) chars⟩$', 1) AS BIGINT), 0)) || ' chars⟩' END"""


@check("clip_lines", _with(LINES, f"once AS (SELECT id, n, {_clip('line', 800)} AS line FROM lines)", f"kept AS (SELECT id, n, 0 AS sub, {_clip('line', 300)} AS line FROM once)") + _folded("kept"))
def q_clip_lines(spark, sf):
    once = folds.rewrite_where("lines", folds.Plain, lambda l: f"length({l}) > 800", lambda l: T.clip(l, 800))
    twice = T.let(once, lambda ls: folds.rewrite_where(ls, folds.Plain, lambda l: f"length({l}) > 300", lambda l: T.clip(l, 300)))
    return _digest(spark, sf, twice)


@check("clip_pages", f"""WITH lines AS (SELECT page_id AS id, unnest(string_split(html, chr(10))) AS line, unnest(range(0, len(string_split(html, chr(10))))) AS n FROM pages),
kept AS (SELECT id, n, 0 AS sub, {_clip('line', 300)} AS line FROM lines) {_folded("kept")}""")
def q_clip_pages(spark, sf):
    cut = T.fn(lambda l: T.clip(l, 300))
    pages = table(spark, sf, "pages").selectExpr("page_id AS id", f"transform(split(html, '\\n', -1), {cut}) AS kept")
    return pages.select("id", F.md5(F.expr(T.join_lines("kept"))).alias("body"), F.size("kept").cast("bigint").alias("lines"))


@check("fingerprint_counts", _with(FPS) + "SELECT fp, count(*) AS lines, count(DISTINCT id) AS outputs FROM fps GROUP BY fp")
def q_fingerprint_counts(spark, sf):
    lines = to_lines(outputs(spark, sf).select("id", "raw")).withColumn("fp", F.expr(T.fingerprint("line")))
    per_output = lines.groupBy("fp", "id").agg(F.count(F.lit(1)).alias("n"))
    return per_output.groupBy("fp").agg(F.sum("n").alias("lines"), F.count(F.lit(1)).alias("outputs"))


COLLAPSE = """isl AS (SELECT *, sum(chg) OVER (PARTITION BY id ORDER BY n) AS g FROM (
    SELECT *, CASE WHEN fp = '' OR fp IS DISTINCT FROM lag(fp) OVER (PARTITION BY id ORDER BY n) THEN 1 ELSE 0 END AS chg FROM fps)),
runs AS (SELECT *, count(*) OVER (PARTITION BY id, g) AS c, row_number() OVER (PARTITION BY id, g ORDER BY n) AS r FROM isl),
kept AS (SELECT id, n, 0 AS sub, CASE WHEN c >= {0} AND r = 2 THEN '    … ⟨×' || c || ' similar lines⟩' ELSE line END AS line FROM runs WHERE c < {0} OR r <= 2)"""


@check("collapse_repeats", _with(FPS, COLLAPSE.format(3)) + _folded("kept"))
def q_collapse(spark, sf):
    return _digest(spark, sf, folds.collapse_repeats(folds.with_fingerprints("lines"), 3))


CAPPED = """ranked AS (SELECT *, count(*) OVER (PARTITION BY id, {key}) AS c, row_number() OVER (PARTITION BY id, {key} ORDER BY n) AS r FROM {source}),
kept AS (SELECT id, n, 0 AS sub, CASE WHEN {on} AND c > 5 AND r = 6 THEN {marker} ELSE line END AS line FROM ranked WHERE NOT ({on}) OR c <= 5 OR r <= 6)"""


@check("cascade_guard", _with(FPS, CAPPED.format(source="fps", key="fp", on="fp != ''", marker="'    … ⟨and ' || (c - 5) || ' more like this⟩'")) + _folded("kept"))
def q_cascade(spark, sf):
    return _digest(spark, sf, folds.cascade_guard(folds.with_fingerprints("lines"), 5))


HITS = r"hits AS (SELECT *, nullif(regexp_extract(line, '^([^\s:][^:]*):\d+:', 1), '') AS file FROM lines)"


@check("limit_per_file", _with(LINES, HITS, CAPPED.format(source="hits", key="file", on="file IS NOT NULL", marker="'    … ⟨+' || (c - 5) || ' more in ' || file || '⟩'")) + _folded("kept"))
def q_limit_per_file(spark, sf):
    return _digest(spark, sf, folds.limit_per_file("lines", 5, folds.Plain))


@check("hits_per_file", _with(LINES, HITS) + "SELECT id, file, count(*) AS hits FROM hits WHERE file IS NOT NULL GROUP BY ALL")
def q_hits(spark, sf):
    return hits_per_file(to_lines(outputs(spark, sf).select("id", "raw")))


@check("keep_ends", _with(LINES, """sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM lines),
kept AS (SELECT id, n, 0 AS sub, line FROM sized WHERE c <= 15 + 20 + 1 OR n < 15 OR n >= c - 20
  UNION ALL SELECT DISTINCT id, 15, 1, '… ⟨' || (c - 35) || ' lines hidden⟩' FROM sized WHERE c > 36)""") + _folded("kept"))
def q_keep_ends(spark, sf):
    return _digest(spark, sf, folds.keep_ends("lines", 15, 20))


@check("slice_lines", _with(LINES, "kept AS (SELECT *, 0 AS sub FROM lines WHERE n BETWEEN 2 AND 6)") + _every("kept"))
def q_slice(spark, sf):
    return _digest(spark, sf, T.slice_lines("lines", "3-7"))


@check("token_estimate", f"SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents")
def q_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(T.tokens("text")).alias("tokens"))


@check("snippet", r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 160) AS snippet FROM documents")
def q_snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.expr(T.snippet("text")).alias("snippet"))
