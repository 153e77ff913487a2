"""Transcript audit on JSONL files written here."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from logsift.plans import audit as A
from logsift.sources.outputs import read_outputs
from logsift.sources.surface import configured_servers
from logsift.sources.transcripts import drop_twins, list_transcripts, read_transcripts


def assistant(session="s1", prompt=(10, 5, 40_000, 10_000), at="2026-07-01T10:00:00Z", side=False, tools=(), server=None, **more):
    usage = dict(zip(("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), prompt))
    content = [{"type": "text", "text": "x"}] + [{"type": "tool_use", "id": i, "name": n} for i, n in tools]
    entry = {"type": "assistant", "sessionId": session, "timestamp": at, "isSidechain": side, "message": {"usage": usage, "content": content}, **more}
    return {**entry, "attributionMcpServer": server} if server else entry


def answer(tool_id, result, session="s1"):
    return {"type": "user", "sessionId": session, "toolUseResult": result, "message": {"content": [{"type": "tool_result", "tool_use_id": tool_id}, {"type": "tool_result", "tool_use_id": "other"}]}}


def token_count(prompt, cached, out, reasoning, at="2026-07-02T00:00:00Z"):
    last = {"input_tokens": prompt, "cached_input_tokens": cached, "output_tokens": out, "reasoning_output_tokens": reasoning}
    return {"timestamp": at, "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": last, "total_token_usage": {"input_tokens": 9}}}}


def step(i, tool="view_file"):
    return {"step_index": i, "created_at": "x", "type": "PLANNER", "status": "DONE", "tool_calls": [{"tool_name": tool}, "odd"]}


@pytest.fixture
def write(tmp_path):
    def go(name, lines):
        path = tmp_path / "logs" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join((line if isinstance(line, str) else json.dumps(line, ensure_ascii=False)) + "\n" for line in lines), encoding="utf-8")
        return path

    go.root = str(tmp_path / "logs")
    return go


def load(spark, write, days=None):
    lines = drop_twins(read_transcripts(spark, [write.root], days), list_transcripts(spark, [write.root], days))
    files = A.vendors(lines).cache()
    ents = A.entries(lines, files)
    return ents, files, A.session_parts(ents)


def test_floors_and_subagents(spark, write):
    write("p/a.jsonl", [
        assistant(prompt=(12, 5, 30_000, 4_000)), assistant(prompt=(7, 1, 33_000, 0)), "not json", "[]", '{"broken', {"type": "user", "sessionId": "s1", "message": {"content": "plain text"}},
        assistant(prompt=(7, 1, 0, 46_500), at="2026-07-03T10:00:00Z"), assistant(prompt=(2, 0, 0, 6_200), side=True), assistant(prompt=(0, 0, 0, 0)),
    ])
    ents, files, parts = load(spark, write)
    got = A.sessions(parts).first()
    assert (got.session, got.requests, got.floor, got.peak, got.date) == ("s1", 3, 33_007, 46_507, "2026-07-03")
    rt = A.runtimes(parts, files).first()
    assert (rt.runtime, rt.requests, rt.session_floor, rt.floor_cost, rt.files) == ("claude", 4, 33_007, 132_028, 1)
    total = A.totals(parts).first()
    assert (total.sessions, total.requests, total.subagent_requests, total.subagent_cache_read_input_tokens) == (1, 4, 1, 6_200)
    assert A.subagent_share(parts).first().subagent_share_pct == round(6_200 * 100 / 56_700, 1)


def test_cost_is_summed_per_runtime(spark, write):
    write("a.jsonl", [assistant(prompt=(21, 0, 48_000, 0)), assistant(prompt=(21, 0, 48_000, 0))])
    write("b.jsonl", [{"type": "session_meta"}, token_count(7_700, 6_100, 3, 2), token_count(0, 0, 0, 0), {"type": "event_msg", "payload": {"type": "token_count", "info": None}}])
    write("c.jsonl", [step(0), step(1), {"odd": 1}])
    ents, files, parts = load(spark, write)
    assert A.fixed_cost(parts).first().floor_cost == 48_021 * 2 + 7_700
    by = {r.runtime: r for r in A.runtimes(parts, files).collect()}
    codex = by["codex"]
    assert (codex.requests, codex.input_tokens, codex.output_tokens, codex.cache_read_input_tokens, codex.session_floor) == (1, 1600, 5, 6100, 7_700)
    gemini = by["gemini"]
    assert (gemini.steps, gemini.tokens_available, gemini.input_tokens, gemini.floor_cost, gemini.requests) == (3, False, None, None, 0)
    assert {r.session for r in A.sessions(parts).filter("runtime = 'codex'").collect()} == {next(iter(files.filter("runtime = 'codex'").collect())).path}
    calls = {(r.runtime, r.tool): r.calls for r in A.calls_by_tool(A.tool_calls(ents)).collect()}
    assert calls == {("gemini", "view_file"): 2, (None, "view_file"): 2}


def test_median_of_an_even_count_is_cut(spark, write):
    write("a.jsonl", [assistant(session="a", prompt=(10, 0, 0, 0)), assistant(session="b", prompt=(13, 0, 0, 0)), assistant(session="c", prompt=(0, 4, 0, 0))])
    _, files, parts = load(spark, write)
    assert A.runtimes(parts, files).first().session_floor == 11
    assert A.sessions(parts).filter("session = 'c'").first().floor == 0


def test_session_names(spark, write):
    rows = [assistant(session=None, uuid="0123456789ab"), assistant(session="", prompt=(7, 0, 0, 0))]
    write("a.jsonl", rows)
    _, _, parts = load(spark, write)
    assert {r.session for r in A.sessions(parts).collect()} == {"01234567", "unknown"}


def test_results_belong_to_their_calls(spark, write):
    result = {"a": "é, x: \"q\\\" y", "b": [1, 2.5, None, True], "c": {}}
    write("a.jsonl", [
        assistant(tools=[("t1", "Read"), ("t2", "Bash")]), answer("t1", "abcé"), answer("t1", "again"), answer("t2", result), answer("t9", "nobody asked"),
        assistant(tools=[("t1", "Grep"), (None, "NoId"), ("t4", "")], side=True), answer("t1", "12"), answer("t4", None), {"type": "user", "message": {"content": None}},
    ])
    write("b.jsonl", [{"type": "response_item", "payload": {"type": "function_call", "name": "shell"}}, {"type": "response_item", "payload": {"type": "custom_tool_call", "tool_name": "patch"}},
                      {"type": "response_item", "payload": {"type": "function_call_output", "output": "12345"}}, {"type": "response_item", "payload": {"type": "custom_tool_call_output", "output": {"x": 1}}}])
    ents, _, _ = load(spark, write)
    sizes = {r.tool: r.size for r in A.result_sizes(A.tool_results(ents)).collect()}
    assert sizes == {"Read": 4, "Bash": len(json.dumps(result, ensure_ascii=False)), "Grep": 2, "codex tool output": 5}
    calls = {r.tool: r.calls for r in A.calls_by_tool(A.tool_calls(ents)).filter("runtime IS NULL").collect()}
    assert calls == {"Read": 1, "Bash": 1, "Grep": 1, "NoId": 1, "?": 1, "shell": 1, "patch": 1}
    assert [r.tool for r in A.top(A.result_sizes(A.tool_results(ents)), "size", 1).collect()] == ["Bash"]


def test_files(spark, write):
    """Format by the first of 20 objects, twins, foreign and empty files, and the window of days."""
    old = write("old.jsonl", [assistant(session="old")])
    os.utime(old, (time.time() - 40 * 86_400,) * 2)
    write("brain/transcript.jsonl", [step(0)])
    write("brain/transcript_full.jsonl", [step(0), step(1)])
    write("alone/transcript.jsonl", [step(0)])
    write("late.jsonl", ["junk"] * 50 + [{"n": i} for i in range(19)] + [assistant(session="late")])
    write("too_late.jsonl", [{"n": i} for i in range(20)] + [assistant(session="too late")])
    write("mixed.jsonl", [assistant(session="m"), token_count(5, 1, 1, 1), step(3)])
    write("foreign.jsonl", ["x", "[1]"])
    write("empty.jsonl", [])
    write("note.txt", [assistant(session="txt")])
    _, files, parts = load(spark, write)
    names = {r.path.rsplit("/logs/", 1)[1]: r.runtime for r in files.collect()}
    assert names == {"old.jsonl": "claude", "brain/transcript_full.jsonl": "gemini", "alone/transcript.jsonl": "gemini", "late.jsonl": "claude", "too_late.jsonl": "claude", "mixed.jsonl": "claude", "foreign.jsonl": None}
    assert {r.session for r in A.sessions(parts).collect()} == {"old", "late", "too late", "m"}
    assert {r.session for r in A.sessions(load(spark, write, days=30)[2]).collect()} == {"late", "too late", "m"}
    listed = list_transcripts(spark, [write.root])
    kept = listed.filter("path NOT LIKE '%brain/transcript.jsonl'")
    # Spark lists no empty files, so empty.jsonl is not counted.
    assert tuple(A.file_quality(files, kept).first()) == (6, 1, 0)
    lost = files.filter("path NOT LIKE '%old.jsonl'")
    assert tuple(A.file_quality(lost, kept).first()) == (5, 1, 1)


def test_damaged_files_are_told_by_their_size(spark, write):
    whole = [assistant(session=f"s{i}") for i in range(400)]
    write("whole.jsonl", whole)
    write("returns.jsonl", [json.dumps(x) + "\r" for x in whole])
    write("no_end.jsonl", whole)
    with open(write.root + "/no_end.jsonl", "a") as last:
        last.write(json.dumps(step(1)))
    broken = write("broken.jsonl", whole)
    sums = broken.stat().st_size // 512 + 1
    # Checksums beside the file: right for no block.
    (broken.parent / ".broken.jsonl.crc").write_bytes(b"crc\0" + (512).to_bytes(4, "big") + b"\1\2\3\4" * sums)
    files, listed = A.read_files(read_transcripts(spark, [write.root])), list_transcripts(spark, [write.root])
    states = {r.path.rsplit("/", 1)[1]: (r.runtime if r.state == "read" else None, r.state) for r in A.file_states(files, listed).collect()}
    assert states == {"whole.jsonl": ("claude", "read"), "returns.jsonl": ("claude", "read"), "no_end.jsonl": ("claude", "read"), "broken.jsonl": (None, "unreadable")}
    assert tuple(A.file_quality(files, listed).first()) == (3, 0, 1)
    assert A.entries(read_transcripts(spark, [write.root])).filter("path LIKE '%returns.jsonl'").count() == 400


def test_servers(spark, write):
    write("a.jsonl", [
        assistant(server="Claude Browser", tools=[("1", "mcp__Claude_Browser__open")]), assistant(server="Claude Browser"), assistant(tools=[("2", "mcp__mail__send")]),
        assistant(tools=[("3", "mcp__Mail__send")]), assistant(tools=[("4", "Read"), ("5", "mcp__broken")]),
    ])
    ents, _, _ = load(spark, write)
    used = A.server_calls(ents).cache()
    got = {r.server: (r.label, r.calls, r.attributed, r.namespaced) for r in used.collect()}
    assert got == {"claude_browser": ("Claude Browser", 3, 2, 1), "mail": ("Mail", 2, 0, 2)}
    docs = [("main.json", "main", json.dumps({"mcpServers": {"mail": {}, "idle-one": {}}, "projects": {"p": {"mcpServers": {"mail": {}, "Chrome": {}}}, "q": 3}})),
            ("set.json", "settings", json.dumps({"enabledPlugins": {"browser@official": True, "off@x": False, "": True, "@odd": True}})), ("list.json", "settings", json.dumps({"enabledPlugins": ["gmail-x@y"]})),
            ("x.json", "extra", json.dumps({"mcpServers": {"idle-one": {}, "solo": {}}})), ("bad.json", "main", "{"), ("odd.json", "main", "[]")]
    configured = configured_servers(spark.createDataFrame(docs, "path string, kind string, text string")).cache()
    assert {r.name: r.source for r in configured.collect()} == {
        "mail": "main.json", "idle-one": "main.json", "Chrome": "main.json (p)", "browser@official": "set.json enabledPlugins", "": "set.json enabledPlugins", "@odd": "set.json enabledPlugins",
        "gmail-x@y": "list.json enabledPlugins", "solo": "x.json"}
    assert {r.name for r in A.idle_surface(configured, used).collect()} == {"idle-one", "Chrome", "solo"}
    report = {(r.name, r.calls, r.source, r.idle) for r in A.server_report(configured, used).collect()}
    assert ("Claude Browser", 3, "not in config", False) in report and ("solo", 0, "x.json", True) in report


def test_outputs_from_files(spark, tmp_path):
    (tmp_path / "one.log").write_text("a\nb\n", encoding="utf-8")
    row = read_outputs(spark, str(tmp_path), "make").select("command", "raw", F.col("ts").isNotNull().alias("dated")).first()
    assert tuple(row) == ("make", "a\nb\n", True)
