"""Sources: outputs from files, rule packs, filters of the user's own."""

from __future__ import annotations

import json
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from checks.audit import FILES
from checks.inputs import CALLS, OUTPUTS, mixed_outputs, outputs, transcripts
from checks.registry import check
from checks.rules import LineSql, _on, pipeline_sql
from logsift.functions.text import fn
from logsift.plans import audit as A
from logsift.plans.compression import compress
from logsift.plans.filters import Filter
from logsift.plans.rules import BUILTIN_RULES, rule
from logsift.scratch import new_path
from logsift.sources.outputs import read_outputs
from logsift.sources.rulepacks import load_rules
from logsift.sources.transcripts import drop_twins, list_transcripts, read_transcripts

RESULT = "SELECT id, label, raw_tokens, comp_tokens, raw_tokens - comp_tokens AS saved, passthrough, md5(body) AS body FROM results"


def _shown(done):
    return done.select("id", "label", "raw_tokens", "comp_tokens", "saved", "passthrough", F.md5("body").alias("body"))


@check("output_source", f"WITH {OUTPUTS} SELECT id % 250 AS part, 'make all' AS command, md5(string_agg(raw || chr(10), '' ORDER BY id)) AS raw FROM outputs GROUP BY ALL")
def q_output_source(spark, sf):
    """Text files, each with some of the outputs, read as one output a file."""
    path = new_path(spark, "output-files")
    parts = outputs(spark, sf).select((F.col("id") % 250).alias("part"), "id", "raw")
    parts.repartition("part").sortWithinPartitions("part", "id").select("part", F.col("raw").alias("value")).write.partitionBy("part").text(path)
    found = read_outputs(spark, path, "make all")
    return found.select(F.regexp_extract("id", r"part=(\d+)/", 1).cast("bigint").alias("part"), "command", F.md5("raw").alias("raw"))


def _write_transcripts(lines, path):
    """Lines as files of their names, written by tasks; those of one runtime with carriage returns. One file gets wrong checksums."""

    def write(rows):
        name, out = None, None
        for row in rows:
            if row.path != name:
                if out:
                    out.close()
                name = row.path
                file = Path(path, name)
                file.parent.mkdir(parents=True, exist_ok=True)
                out = file.open("wb")
            out.write(row.line.encode() + (b"\r\n" if name.startswith("gemini/") else b"\n"))
        if out:
            out.close()

    lines.repartition("path").sortWithinPartitions("path", "block", "pos").foreachPartition(write)
    cut = Path(path, CUT)
    cut.with_name(f".{cut.name}.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\1\2\3\4" * (cut.stat().st_size // 512 + 1))


CUT = "codex/u3.jsonl"


@check("transcript_source", f"""WITH {CALLS}, {FILES} SELECT path, CASE WHEN path != '{CUT}' THEN runtime END AS runtime, CASE WHEN path = '{CUT}' THEN 'unreadable' ELSE 'read' END AS state FROM paths
UNION ALL SELECT 'other/tool.jsonl', NULL, 'unrecognised'""")
def q_transcript_source(spark, sf):
    """Transcripts written as files and read back: twins left out, a damaged file found by its size."""
    path = new_path(spark, "transcripts").removeprefix("file:")
    _write_transcripts(transcripts(spark, sf), path)
    listed = list_transcripts(spark, [path])
    lines = drop_twins(read_transcripts(spark, [path]), listed)
    states = A.file_states(A.read_files(lines), drop_twins(listed.withColumn("pos", F.lit(0)), listed))
    return states.select(F.substring_index("path", f"{Path(path).name}/", -1).alias("path"), F.when(F.col("state") == "read", F.col("runtime")).alias("runtime"), "state")


PACKS = {
    "10-own.json": [{"name": "own-steps", "match": "make|git", "actions": [{"drop_lines": "^step 1"}, {"collapse_repeats": 2}]}, "no rule", {"name": "own-stop", "match": "docker", "stop": True, "actions": [{"keep_head_tail": [4, 2]}]}],
    "20-late.json": [{"name": "own-late", "match": "docker|curl", "actions": [{"max_line_len": 60}]}],
}
PACKED = [
    *BUILTIN_RULES, rule("own-steps", "make|git", ("drop_lines", "^step 1"), ("collapse_repeats", 2)),
    rule("own-stop", "docker", ("keep_head_tail", [4, 2]), stop=True), rule("own-late", "docker|curl", ("max_line_len", 60)),
]


@check("pack_rules", pipeline_sql(PACKED, mixed=True) + RESULT)
def q_pack_rules(spark, sf):
    """Packs of a folder behind the built-in rules; what is no pack and no rule is left out."""
    folder = Path(tempfile.mkdtemp(prefix="packs-"))
    for name, entries in PACKS.items():
        (folder / name).write_text(json.dumps(entries))
    (folder / "00-broken.json").write_text("[{")
    (folder / "notes.txt").write_text("[]")
    return _shown(compress(mixed_outputs(spark, sf), rules=load_rules(str(folder))))


def _own(lines, opts):
    return f"filter({lines}, {fn(lambda l: f"NOT startswith({l}, 'step 1')")})"


OWN = [Filter("no-firsts", r"\b(make|curl)\b", _own), Filter("never", "make", lambda lines, opts: "array('x')")]


def _own_sql() -> str:
    sql = LineSql(mixed=True)
    before = sql.now
    sql.drop(_on(OWN[0].match), "starts_with(line, 'step 1')")
    sql.mark(OWN[0].name, before)
    sql.rules(BUILTIN_RULES)
    return sql.results()


@check("user_filters", _own_sql() + RESULT)
def q_user_filters(spark, sf):
    """Filters registered in place of the built-in ones; the first that matches wins."""
    return _shown(compress(mixed_outputs(spark, sf), filters=OWN))
