"""The folds on line tables, against the same SQL as the folds inside rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import LINES, outputs
from checks.registry import check
from checks.rules import NOISY
from checks.text import CAPPED, COLLAPSE, FPS, HITS, _with
from logsift.operators import linefolds
from logsift.operators.lines import in_blocks, to_lines
from logsift.plans.linechain import compress_line_table


def _lines(spark, sf):
    """Short blocks, so that runs and keys cross their edges."""
    return in_blocks(to_lines(outputs(spark, sf).select("id", "raw")), 8)


@check("line_collapse", _with(FPS, COLLAPSE.format(3)) + "SELECT id, n, line FROM kept")
def q_collapse(spark, sf):
    return linefolds.collapse_repeats(_lines(spark, sf), 3).drop("block")


@check("line_cascade", _with(FPS, CAPPED.format(source="fps", key="fp", on="fp != ''", marker="'    … ⟨and ' || (c - 5) || ' more like this⟩'")) + "SELECT id, n, line FROM kept")
def q_cascade(spark, sf):
    return linefolds.cascade_guard(_lines(spark, sf), 5).drop("block")


@check("line_limit", _with(LINES, HITS, CAPPED.format(source="hits", key="file", on="file IS NOT NULL", marker="'    … ⟨+' || (c - 5) || ' more in ' || file || '⟩'")) + "SELECT id, n, line FROM kept")
def q_limit(spark, sf):
    return linefolds.limit_per_file(_lines(spark, sf), 5).drop("block")


@check("line_ends", _with(LINES, """sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM lines)""") + """SELECT id, n, line FROM sized WHERE c <= 15 + 20 + 1 OR n < 15 OR n >= c - 20
  UNION ALL SELECT DISTINCT id, 15, '… ⟨' || (c - 35) || ' lines hidden⟩' FROM sized WHERE c > 36""")
def q_ends(spark, sf):
    return linefolds.keep_ends(_lines(spark, sf), 15, 20).drop("block")


@check("compress_line_table", NOISY + "SELECT id, label, raw_tokens, comp_tokens, raw_tokens - comp_tokens AS saved, passthrough, md5(body) AS body FROM results")
def q_pipeline(spark, sf):
    """The whole pipeline on lines in short blocks: the rows of ``compress_outputs``."""
    done = compress_line_table(_lines(spark, sf), outputs(spark, sf).select("id", "command"))
    texts = done.bodies.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("lines"))
    body = F.md5(F.coalesce(F.array_join("lines.line", "\n"), F.lit(""))).alias("body")
    return done.results.join(texts, "id", "left").select("id", "label", "raw_tokens", "comp_tokens", "saved", "passthrough", body)
