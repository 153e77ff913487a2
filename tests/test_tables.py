"""JSON views, payloads, the recall table, search, names and packs on small literal frames."""

from __future__ import annotations

import datetime as dt

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from logsift.functions import labels
from logsift.functions import payload as P
from logsift.functions.jsonview import is_json, json_view
from logsift.operators import jsonshape, packs, search
from logsift.operators import store as S
from logsift.options import Options


def values(spark, column, rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, v string")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_json_view_depth_and_kinds(spark):
    deep = {"a": {"b": {"c": {"d": {"e": {"f": {"g": {"h": 1, "i": 2}, "x": 5, "l": [1]}}}}}}}
    docs = [json.dumps(deep), json.dumps({"s": "x" * 250, "n": None, "f": 1.50, "t": True, "e": 1e20}), "  [1,2] ", "{bad", "plain", '{"a":1,"a":2}', "[NaN]"]
    got = values(spark, json_view, docs)
    inner = json.loads(got[0])["a"]["b"]["c"]["d"]["e"]["f"]
    assert inner == {"g": {"h": 1, "i": 2}, "x": 5, "l": [1]}
    assert json.loads(got[1])["s"] == "x" * 200 + "… ⟨+50 chars⟩"
    assert got[2] == "[\n  1,\n  2\n]" and got[3] is got[4] is None
    assert json.loads(got[5]) == {"a": 2} and got[6] == "[\n  NaN\n]"
    shallow = values(spark, lambda c: json_view(c, Options(json_max_depth=3)), [json.dumps(deep), '{"a":{"b":{"c":[1]}}}', '{"a":{"b":{"c":{}}}}'])
    assert json.loads(shallow[0])["a"]["b"]["c"] == "⟨object with 1 key elided at depth limit⟩"
    assert json.loads(shallow[1])["a"]["b"]["c"] == "⟨array of 1 item elided at depth limit⟩"
    assert json.loads(shallow[2])["a"]["b"]["c"] == "⟨object with 0 keys elided at depth limit⟩"


def by_parser(doc, items=8, chars=200, depth=8):
    """What the view shows, by way of the standard library's parser."""
    try:
        root = json.loads(doc.strip())
    except ValueError:
        return None
    if not isinstance(root, (dict, list)):
        return None
    box = [root]
    todo = [(box, 0, 0)]  # a container, a place in it, how deep that place is
    while todo:
        held, at, level = todo.pop()
        node = held[at]
        if isinstance(node, str) and level < depth and len(node) > chars:
            held[at] = f"{node[:chars]}… ⟨+{len(node) - chars} chars⟩"
        if isinstance(node, (dict, list)):
            n, of = len(node), ("object with {} key{}", "array of {} item{}")[isinstance(node, list)]
            if level >= depth:
                held[at] = f"⟨{of.format(n, '' if n == 1 else 's')} elided at depth limit⟩"
                continue
            if isinstance(node, list) and n > items:
                node[items:] = [f"… ⟨{n - items} more of {n} items⟩"]
                n = items
            todo += [(node, k, level + 1) for k in (node if isinstance(node, dict) else range(n))]
    return json.dumps(box[0], indent=2, ensure_ascii=False).encode("utf-8", "replace").decode()


def spelled_json(rng, level=0):
    """A random document with odd spacing, escapes and numbers."""
    gap = lambda: rng.choice(["", "", " ", "\n\t", "\r\n  "])
    text = lambda: '"' + "".join(rng.choice(["a", "é", "🙂", "\\n", "\\\\", '\\"', "\\/", "\\u00e9", "\\u000b", "\\u001F", "\\\\u000B", "\\ud83d\\ude00", "\\ud83d", " ", "{", "]", ",", "\x7f"]) for _ in range(rng.choice([0, 3, 30]))) + '"'
    kind = rng.randrange(8) if level < 6 else rng.randrange(2, 8)
    if kind == 0:
        return "{" + gap() + ("," + gap()).join(f'"k{k}{rng.choice(["", chr(233), chr(92) + "t"])}"{gap()}:{gap()}{spelled_json(rng, level + 1)}{gap()}' for k in range(rng.randrange(4))) + "}"
    if kind == 1 or level == 0:
        return "[" + gap() + ("," + gap()).join(spelled_json(rng, level + 1) + gap() for _ in range(rng.randrange(6))) + "]"
    number = rng.choice([str(rng.randrange(-(10**20), 10**20)), repr(rng.uniform(-1e3, 1e3)), f"{rng.random():.3e}", f"{rng.randrange(1000)}.{rng.randrange(100)}00E{rng.randrange(-30, 40)}", "-0", "0.0", "-0.0", "1e400", "-1E999", "5e-324", "1e16", "123456789012345680.0", "0.0001", "0.00001", "1e22", "1.0"])
    return [text(), text(), number, number, "true", "null"][kind - 2]


@pytest.mark.parametrize("limits", [(8, 200, 8), (2, 5, 2), (0, 0, 1), (1, 3, 0)])
def test_json_view_against_a_parser(spark, limits):
    rng = random.Random(21)
    docs = [rng.choice(["", " \n", "\u3000"]) + spelled_json(rng) + rng.choice(["", "\n", "\u2003"]) for _ in range(250)]
    broken = []
    for doc in docs[:120]:  # a character dropped, doubled or put in
        at = rng.randrange(len(doc))
        broken.append(doc[:at] + rng.choice(["", doc[at] * 2, rng.choice('[]{},:"0-.\\e\n\x01')]) + doc[at + 1 :])
    docs += broken + ["[]", "{}", "[[],{}]", "[1 2]", "[1,]", "{,}", '{"a"}', '{"a":}', '["a":1]', "[}", "{]", "[1]]", "[1][2]", "[-]", "[+1]", "[01]", "[1.]", "[.5]", "[1e]", "[nul]", "[NaN,-Infinity,Infinity]", "[--Infinity]", '["\\x"]', '["\\u12"]', '["', "[", '{"a":{"b":[1,{"c":', "[\xa0]", '["\t"]', "[" + "9" * 4300 + "]", "[" + "9" * 4301 + "]", "[" + "[" * 200 + "]" * 200 + "]"]
    items, chars, depth = limits
    opts = Options(json_max_array=items, json_max_str=chars, json_max_depth=depth)
    got = values(spark, lambda c: json_view(c, opts), docs)
    want = [by_parser(d, items, chars, depth) for d in docs]
    assert [(d, g, w) for d, g, w in zip(docs, got, want, strict=True) if g != w] == []
    assert sum(w is None for w in want) > 50 and sum(w is not None for w in want) > 200


def test_json_view_of_large_documents(spark):
    docs = [json.dumps({f"key {k}": [k, {"x": "y" * 300}] for k in range(20_000)}), json.dumps([[k, "text " * 3] for k in range(100_000)]), json.dumps("x" * 10)[:0] + '["' + "\\n" * 100_000 + '"]']
    assert values(spark, json_view, docs) == [by_parser(d) for d in docs]


def test_json_rows(spark):
    assert values(spark, is_json, ['{"a":1}', " \n[1]", "[1", "7", '"x"', ""]) == [True, True, False, False, False, False]


def test_json_nodes(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,"xy",null,{"b":true}],"c":{}}'), (2, "no")], "id long, raw string")
    got = {(r.path, r.kind): (r.depth, r.size) for r in jsonshape.json_nodes(docs).collect()}
    assert got == {
        ("$", "object"): (0, 2), ("$.a", "array"): (1, 4), ("$.c", "object"): (1, 0), ("$.a[]", "number"): (2, None), ("$.a[]", "string"): (2, 2),
        ("$.a[]", "null"): (2, None), ("$.a[]", "object"): (2, 1), ("$.a[].b", "boolean"): (3, None),
    }


@pytest.mark.parametrize("cap", [1, 2, 3, 5, 6, 7, 10, 11, 99])
def test_payload_cut_at_a_character(spark, cap):
    texts = ["héé🙂🙂x", "aaaaaaaaaaa", "🙂" * 5, "é" * 6, ""]
    for text, got in zip(texts, values(spark, lambda c: P.capped(c, cap), texts)):
        data = text.encode()
        if len(data) <= cap:
            assert got == text
        else:
            kept = data[:cap].decode("utf-8", "ignore")
            assert got.startswith(kept + "\n[stored head only, ")
            assert f" {len(data) - len(kept.encode()):,} more bytes" in got


def test_handles_grow_until_unique(spark):
    names = ["abcdef00", "abcdef01", "abcdefff", "000000aa", "abcde0aa"]
    df = spark.createDataFrame([(n.ljust(64, "0"),) for n in names], "name string")
    got = {r.name[:8]: r.handle for r in S.with_handles(df).collect()}
    assert got == {"abcdef00": "abcdef00", "abcdef01": "abcdef01", "abcdefff": "abcdeff", "000000aa": "000000", "abcde0aa": "abcde0"}
    assert values(spark, P.is_handle, ["abc123", "ABC123", "abc1234", "abc12"]) == [True, False, True, False]


def rows(spark, spec):
    """(id, seconds, size) triples as a recall table."""
    start = datetime(2024, 1, 1)
    data = [(i, start + timedelta(seconds=s), f"cmd {i}", "x" * n, n, n // 2, "f") for i, s, n in spec]
    return spark.createDataFrame(data, "id long, ts timestamp, command string, raw string, raw_tokens long, comp_tokens long, filt string")


def test_byte_cap_drops_the_oldest(spark):
    table = rows(spark, [(i, i * 40_000, 2000) for i in range(6)])
    kept = lambda cap: sorted(r.id for r in S.cap_bytes(table, cap).collect())
    assert kept(6000) == [3, 4, 5] and kept(5999) == [4, 5] and kept(12_000) == list(range(6))
    assert kept(0) == kept(None) == list(range(6)) and kept(1999) == []
    assert sorted(r.id for r in S.cap_rows(table, 2).collect()) == [4, 5] and S.cap_rows(table, 0).count() == 6


def test_caps_agree_with_a_plain_loop(spark):
    """Many rows of one instant, of one second, of one day: the cap is exact in all of them."""
    import hashlib

    rng = random.Random(3)
    spec = [(i, rng.choice([0, 0, 0, 5, 5.25, 5.5, 86_400, 90_000]), rng.randint(0, 30)) for i in range(200)]
    table = rows(spark, spec)
    newest = sorted(spec, key=lambda r: (r[1], hashlib.md5(str(r[0]).encode()).hexdigest()), reverse=True)
    for cap in (1, 50, 500, 1500, 2500, 10_000):
        total, want = 0, set()
        for i, _, n in newest:
            total += n
            if total > cap:
                break
            want.add(i)
        assert {r.id for r in S.cap_bytes(table, cap).collect()} == want
        assert {r.id for r in S.cap_rows(table, cap).collect()} == {i for i, _, _ in newest[:cap]}


def test_recent_discover_totals(spark):
    table = rows(spark, [(i, i, n) for i, n in enumerate([900, 10, 30, 20, 30])])
    assert [r.id for r in S.recent(table, 2).collect()] == [4, 3]
    assert [r.id for r in S.discover(table, 2, among=4).collect()] == [4, 2]
    got = S.totals(table).first()
    assert (got.outputs_held, got.tokens_in, got.tokens_out, got.tokens_saved, got.reduction_pct) == (5, 990, 495, 495, 50.0)
    empty = S.totals(table.filter("id < 0")).first()
    assert (empty.outputs_held, empty.tokens_in, empty.reduction_pct) == (0, 0, 0.0)


def test_store_is_written_by_day_and_read_back(spark, tmp_path):
    done = rows(spark, [(1, 0, 50), (2, 90_000, 70)]).selectExpr("*", "filt AS label", "'/' AS cwd", "0 AS exit_code", "id = 1 AS passthrough")
    S.write_store(S.store_rows(done, Options(max_row_bytes=60)), str(tmp_path / "s"))
    back = S.read_store(spark, str(tmp_path / "s")).collect()
    assert [(r.id, str(r.day), r.raw_tokens) for r in back] == [("2", "2024-01-02", 70)] and "10 more bytes" in back[0].raw
    assert S.store_rows(done, store_all=True).count() == 2


def test_store_is_cut_on_disk(spark, tmp_path):
    path = str(tmp_path / "s")
    times = [0, 10, 90_000, 90_000, 90_005, 180_000, 180_001, 270_000]
    done = rows(spark, [(k, t, 20 + k) for k, t in enumerate(times)]).selectExpr("*", "filt AS label", "'/' AS cwd", "0 AS exit_code", "false AS passthrough")
    held = S.store_rows(done.union(done.withColumn("ts", F.lit(None).cast("timestamp")).filter("id = 0").withColumn("id", F.lit("99"))), store_all=True)
    S.write_store(held, path)
    S.write_names(spark, path)
    name = {r.id: r.name for r in S.read_store(spark, path).collect()}
    assert [r.id for r in S.recall_in(spark, path, name["4"][:9]).collect()] == ["4"] and [r.id for r in S.recall_in(spark, path, name["99"]).collect()] == ["99"]
    assert S.recall_in(spark, path, "zz").count() == 0
    assert S.prune_store(spark, path, Options()) == 0 and S.read_store(spark, path).count() == 9
    want = {r.id for r in S.cap_rows(S.read_store(spark, path), 5).collect()}
    assert S.prune_store(spark, path, Options(max_store_rows=5)) == 4
    left = S.read_store(spark, path)
    assert {r.id for r in left.collect()} == want and "99" not in want and sorted(p.name for p in (tmp_path / "s").glob("day=*")) == ["day=2024-01-02", "day=2024-01-03", "day=2024-01-04"]
    room = sum(r.bytes for r in left.filter("id in ('5', '6', '7')").collect())
    assert S.prune_store(spark, path, Options(max_store_bytes=room)) == 2
    assert sorted(r.id for r in S.read_store(spark, path).collect()) == ["5", "6", "7"]
    assert S.prune_store(spark, path, Options(max_store_bytes=room)) == 0
    assert S.prune_store(spark, path, Options(max_store_rows=1)) == 2 and [r.id for r in S.read_store(spark, path).collect()] == ["7"]


def test_recent_reads_newer_days_only(spark, tmp_path):
    path = str(tmp_path / "s")
    done = rows(spark, [(k, 90_000 * k, 20) for k in range(6)]).selectExpr("*", "filt AS label", "'/' AS cwd", "0 AS exit_code", "false AS passthrough")
    S.write_store(S.store_rows(done, store_all=True), path)
    store = S.read_store(spark, path)
    assert [r.id for r in S.recent(store, 2).collect()] == ["5", "4"] and len(S.recent(store, 2).select("id").inputFiles()) >= 1
    plan = S.recent(store, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and [r.id for r in S.recent(store, 99).collect()] == ["5", "4", "3", "2", "1", "0"]
    assert S.recent(store, 0).count() == 0 and S.recent(store.limit(0), 3).count() == 0


def test_signatures_leave_files_unread(spark, tmp_path):
    path = str(tmp_path / "s")
    texts = ["alpha Beta", "gamma ÉTÉ fin", "delta", "x%y_z", ""]
    for k, text in enumerate(texts):  # a file each
        spark.createDataFrame([(k, datetime(2024, 1, k + 1), f"cmd{k}", text)], "id long, ts timestamp, command string, raw string").coalesce(1).write.mode("append").parquet(path)
    search.write_signatures(spark.read.parquet(path), path)
    files = lambda q: len(search.files_with(spark, path, q))
    ids = lambda q: [r.id for r in search.search_like_in(spark, path, q).collect()]
    assert ids("LPHA b") == [0] and files("LPHA b") == 1
    assert ids("ÉTÉ") == [1] and files("ÉTÉ") == 1 and ids("cmd3") == [3] and ids("nowhere") == [] and files("nowhere") == 0
    assert ids("gam%fin") == [1] and files("gam%fin") == 1 and files("a%b") == 5 and ids("a_pha") == [0] and sorted(ids("")) == [0, 1, 2, 3, 4]
    spark.createDataFrame([(9, datetime(2024, 2, 1), "new", "nowhere")], "id long, ts timestamp, command string, raw string").coalesce(1).write.mode("append").parquet(path)
    assert ids("nowhere") == [9] and files("nowhere") == 1  # not signed yet


def test_search(spark, tmp_path):
    data = [(1, "git log", "Été fini\nERROR: disk full"), (2, "docker logs", "error 100% done"), (3, "ls", "a_b\\c")]
    table = spark.createDataFrame([(i, datetime(2024, 1, i), c, r) for i, c, r in data], "id long, ts timestamp, command string, raw string")
    index = search.postings(table)
    ids = lambda q, **k: [r.id for r in search.search(table, index, q, **k).collect()]
    assert ids("error") == [2, 1] and ids("error", limit=1) == [2] and ids("ete LOGS error") == [] and ids("ÉTÉ error git") == [1]
    assert ids("rror: D") == [1] and ids("100%") == [2] and ids("r%f_ll") == [1] and ids("b\\c") == [3] and ids("***") == [] and ids("nope") == []
    search.write_postings(index, str(tmp_path / "i"))
    laid = spark.read.parquet(str(tmp_path / "i"))
    assert [r.id for r in search.search_terms(table, laid, "disk error").collect()] == [1]
    assert {(r.term, r.tf) for r in index.filter("id = 3 AND field = 'raw'").collect()} == {("a", 1), ("b", 1), ("c", 1)}


def test_word_queries(spark, tmp_path):
    texts = [
        ("make all", "disk full on node one\ndisk nearly full"), ("docker logs api", "node one is full; disk-full: no"), ("git log", "full disk, full"),
        ("deploy now", "nodes one two three"), ("disk check", "all fine"), ("echo", "foo_bar and bar foo"), ("disk", None),
    ]
    table = spark.createDataFrame([(i, datetime(2024, 1, 20 - i), c, r) for i, (c, r) in enumerate(texts)], "id long, ts timestamp, command string, raw string")
    search.write_postings(search.postings(table), str(tmp_path / "i"))
    laid = spark.read.parquet(str(tmp_path / "i"))

    def ids(query):
        return [r.id for r in search.newest_hits(laid, query).collect()]

    want = {
        '"disk full"': [0, 1, 2], '"full disk"': [1, 2], '"full disk full"': [1, 2], '"full full"': [], "disk full": [0, 1, 2], "disk OR three": [0, 1, 2, 3, 4, 6],
        "disk NOT full": [4, 6], "full NOT node NOT one": [2], "node* one": [0, 1, 3], '"nearly fu"*': [0], "nod* OR fo*": [0, 1, 3, 5], "command:disk": [4, 6],
        "raw:disk": [0, 1, 2], 'raw:"node one"': [0, 1], "foo_bar": [5], '"foo bar"': [5], "bar_foo": [5], '"one disk"': [0],
        "two OR disk AND all": [0, 3, 4], "(two OR disk) AND all": [0, 4], '"" disk all': [0, 4], '""': [], "DISK Full NOT (api OR git)": [0], '"say ""disk"""': [],
        "disk NOT nothing": [0, 1, 2, 4, 6], "nothing NOT disk": [],
    }
    assert {q: ids(q) for q in want} == want
    for broken in ("disk AND", "OR disk", "(disk", "disk)", "a-b", "other:disk", "*", '"disk', "NOT disk", "a:b:c", "disk (full)"):
        with pytest.raises(search.NotAQuery):
            search.parsed_query(broken)


def test_names(spark):
    assert values(spark, labels.client_label, [" Claude-Code", "LMSTUDIO", "other", ""]) == ["claude", "local", "unknown", "unknown"]
    assert values(spark, labels.namespace, ["mcp__a__b", "mcp__a__b__c", "mcp__a", "Read", "mcp____x"]) == ["a", "a", None, None, ""]
    assert values(spark, labels.canonical, [" Claude Browser ", "claude-in-chrome", "__É1__", "--"]) == ["claude_browser", "claude_in_chrome", "é1", ""]
    ages = ["-5", "89", "90", "119", "3599", "3600", "7199", "7200", "90000"]
    assert values(spark, lambda c: labels.elapsed(c.cast("long")), ages) == [
        "moments ago", "moments ago", "1 minutes ago", "1 minutes ago", "59 minutes ago", "1 hour ago", "1 hour ago", "2 hours ago", "25 hours ago"]


def test_client_from_markers(spark):
    cases = [(None, {"CODEX_HOME": "x", "CLAUDECODE": "1"}, "codex"), ("", {"CLAUDE_CODE": "1", "LOCALAGENT": "1"}, "claude"), ("antigravity", {"CODEX_HOME": "x"}, "gemini"),
             ("what", {"CODEX_HOME": "x"}, "unknown"), (None, {"LOGSIFT_CLIENT": "local", "CODEX_HOME": "x"}, "local"), (None, {"CODEX_HOME": ""}, "unknown"), (None, None, "unknown")]
    df = spark.createDataFrame([(i, n, e) for i, (n, e, _) in enumerate(cases)], "i int, n string, e map<string,string>")
    got = df.select("i", labels.client_from_markers(F.col("n"), F.col("e")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == [c for _, _, c in cases]


def test_reference_packs(spark):
    files = spark.createDataFrame([("/a", "x" * 4000), ("/b", "y" * 40)], "path string, text string")
    tasks = spark.createDataFrame(
        [("t1", " do it ", ["/a", "/b", "/a"], ["/new"], ["ok", "ok"], 50), ("t2", "small", ["/b"], None, [], 0), ("t3", " ", [], [], [], None),
         ("t4", "x", ["/gone", "/b"], [], [], None), ("t5", "x", [], [], [], -1), ("t6", "none", [], [], [], None)],
        "task_id string, task string, refs array<string>, owns array<string>, checks array<string>, report_words int",
    )
    got = {r.task_id: r for r in packs.reference_packs(tasks, files).collect()}
    assert got["t1"].prompt.split("\n")[2:] == [
        "Read these exact reference files before acting:", "- /a", "- /b", "Edit these owned paths directly:", "- /new", "Acceptance checks:", "- ok",
        "Task: do it", "Return a report of no more than 50 words."]
    assert got["t1"].referenced_tokens == 1010 and got["t1"].avoided_tokens == 1010 - got["t1"].embedded_tokens == 1010 - round(len(got["t1"].prompt) / 4)
    assert got["t2"].avoided_tokens == 0 and "report" not in got["t2"].prompt
    assert [got[t].error for t in ("t3", "t4", "t5")] == ["task is empty", "no such file: /gone", "report words must not be negative"]
    assert got["t4"].prompt is None and got["t6"].referenced_tokens == 0 and "120 words" in got["t6"].prompt


def test_caps_with_rows_without_a_time(spark):
    rows = [(k, dt.datetime(2024, 1, 1 + k, tzinfo=dt.timezone.utc), "x" * 10) for k in range(5)] + [(10 + k, None, "x" * 100) for k in range(3)]
    table = spark.createDataFrame(rows, "id long, ts timestamp, raw string")
    for cap, n in ((30, 3), (60, 5), (120, 5), (150, 6), (350, 8)):
        assert S.cap_bytes(table, cap).count() == n
    assert S.cap_bytes(table, 120).where("ts is null").count() == 0
    assert S.cap_rows(table, 6).where("ts is not null").count() == 5 and S.cap_rows(table, 6).count() == 6


def test_json_report_runs_its_python_step_once(spark):
    docs = spark.createDataFrame([(k, json.dumps({"n": k, "v": 7, "text": "x" * 300}) if k % 3 else "[broken") for k in range(600)], "id long, raw string").coalesce(1)
    report = jsonshape.json_report(docs.withColumn("view", F.lit("old")))
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and report.columns == ["id", "view", "tokens_before", "tokens_after", "saved_pct"]
    got = {r.id: r for r in report.collect()}
    assert sorted(got) == [k for k in range(600) if k % 3] and json.loads(got[599].view)["n"] == 599
    assert docs.select(json_view(F.col("raw")).alias("v")).where("v IS NULL").count() == 200
