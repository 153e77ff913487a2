from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from logsift.options import Options
from logsift.plans.filters import Filter
from logsift.plans.compression import compress, footer, render
from logsift.plans.rules import BUILTIN_RULES, java_replacement, rule, rule_from_dict
from logsift.sources.rulepacks import load_rules, rule_table


@pytest.fixture
def run(spark):
    def go(command, raw, **options):
        df = spark.createDataFrame([("1", command, raw)], "id string, command string, raw string")
        done = compress(df, **options)
        return done.select("*", footer(done).alias("footer"), render(done).alias("shown")).first()

    return go


def test_noise_wall(run):
    told = ["[1/4] resolving", "warning left-pad > tiny: please move on", "[2/4] fetching", "WARNING: peer react is missing", "  npm notice new minor version"]
    raw = "\n".join(told * 17 + ["success Saved lockfile.", "Done in 3.21s."])
    got = run("yarn add left-pad", raw)
    assert got.label == "npm-install"
    assert got.body == "\n".join(["[1/4] resolving", "[2/4] fetching"] * 17 + ["success Saved lockfile.", "Done in 3.21s.", "… ⟨51 npm warn/notice lines hidden⟩"])
    assert got.saved == got.raw_tokens - got.comp_tokens > 0 and not got.passthrough
    assert got.shown == got.body + "\n" + got.footer and got.handle in got.footer
    assert got.raw == raw


def test_pip_keeps_errors_and_other_lines(run):
    raw = "\n".join(["Requirement already satisfied: a"] * 60 + ["  Downloading error.txt", "Successfully installed b"])
    assert run("python -m pip install b", raw).body == "  Downloading error.txt\nSuccessfully installed b\n… ⟨60 pip progress lines hidden⟩"


def test_git_status(run):
    lines = ["On branch main", '  (use "git add" to x)', "", '  (use "git restore" to y)', " ", "end"]
    assert run("git  status", "\n".join(lines * 3), opts=Options(min_tokens=0, min_saving=0)).body.split("\n") == [
        "On branch main", "", "end"] * 3


def test_log_stream(run):
    polls = [f"Mar 03 08:{m:02d}:{m * 7 % 60:02d} box7 cron[{4100 + m}]: poll of queue {m % 3} took {m + 2}ms" for m in range(43)]
    faults = [f"Mar 03 09:00:{s:02d} box7 mount[77]: disk 0x{s + 4096:x} slow" for s in range(9)]
    got = run("journalctl -u cron", "\n".join([*polls, "-- reboot --", *faults]))
    assert got.label == "fold-repeats"
    assert got.body.split("\n") == [polls[0], "    … ⟨×43 similar lines⟩", "-- reboot --", faults[0], "    … ⟨×9 similar lines⟩"]


def test_scattered_errors(run):
    lines = [line for i in range(30) for line in (f"error {i}", f"only {'abcdefghijklmnopqrstuvwxyzABCDEFGH'[i]}")]
    got = run("tail -f x", "\n".join(lines), opts=Options(min_tokens=0, min_saving=0))
    assert "… ⟨and 25 more like this⟩" in got.body and got.label == "log-streams"


def test_search_hits(run):
    raw = "\n".join([f"src/server.rs:{i}:  call_{i}(ctx) then" for i in range(1, 41)] + ["docs/n.md:1: once", "Binary file matches"])
    got = run("rg -n call", raw)
    assert got.label == "ripgrep" and got.body.count("src/server.rs:") == 5
    assert "+35 more in src/server.rs" in got.body and got.body.endswith("docs/n.md:1: once\nBinary file matches")


def test_a_long_hit_is_clipped_by_both_rules(run):
    got = run("rg -n needle lib/", "lib/hay.py:7:" + "n" * 1500)
    assert got.label == "clip-monster-lines+ripgrep" and got.body.startswith("lib/hay.py:7:nnn") and len(got.body) < 400


def test_a_failure_stays_among_dropped_lines(run):
    steps = [f"   Compiling part{i} v3.1.0" for i in range(25)]
    assert run("cargo build", "\n".join([*steps, "error: could not find `main`", *steps])).body == "error: could not find `main`"


@pytest.mark.parametrize(("action", "want"), [
    (("drop_lines", "^[[]"), "a&&b\nxxx\n]z"), (("drop_lines", "[a&&b]$"), "[x\nxxx\n]z"), (("keep_lines", "^x{,3}$"), "xxx"),
    (("keep_lines", "[]]"), "]z"), (("drop_lines", "^[^[]"), "[x"), (("drop_lines", "(?P<a>x)(?(a)y|z)"), "[x\na&&b\nxxx\n]z"),
    (("replace", ["x{3}|{", "{"]), "[x\na&&b\n{\n]z"), (("replace", [r"[\[\]]", "("]), "(x\na&&b\nxxx\n(z"),
])
def test_patterns_of_the_other_dialect(run, action, want):
    assert run("any", "[x\na&&b\nxxx\n]z", rules=[rule("r", ".", action)], opts=Options(min_tokens=0, min_saving=-9)).body == want


def test_a_match_only_python_knows_never_matches(run):
    rules = [rule("r", "(?P<a>x)?(?(a)y|.)", ("drop_lines", "."))]
    assert run("any", "kept", rules=rules, opts=Options(min_tokens=0, min_saving=-9), filters=[Filter("f", "[[", lambda lines, opts: lines)]).body == "kept"


def test_everything_dropped_is_empty_text(run):
    got = run("pkg install x", "\n".join(f"[{i}/9] Fetching a-{'bcdefghijklm'[i]}: done" for i in range(9)))
    assert (got.body, got.comp_tokens, got.label) == ("", 0, "fold-repeats+pkg-freebsd") or (got.body, got.comp_tokens) == ("", 0)


def test_small_or_unchanged_passes_through(run):
    for raw in ("hi", "", "\n".join(f"all {w} different" for w in "abcdefghijklmnopqrstuvwxyz" for _ in "1")):
        got = run("make", raw)
        assert got.passthrough and got.body == raw and got.label == "passthrough" and got.handle is None and got.saved == 0
        assert got.shown == raw and got.footer.endswith(f"({got.raw_tokens} tok)⟩")


def test_bom_is_not_in_the_view(run):
    got = run("npm ci", "﻿npm warn x\n" + "npm notice y\n" * 60 + "done")
    assert got.body.startswith("done") and got.raw.startswith("﻿")


def test_json_is_exclusive(run):
    doc = {"items": [{"id": i, "name": f"n{i}"} for i in range(300)], "z": 1.10, "a": "é"}
    got = run("rg x", json.dumps(doc, indent=2))
    assert got.label == "json" and list(json.loads(got.body)) == ["items", "z", "a"]
    assert json.loads(got.body)["items"][-1] == "… ⟨292 more of 300 items⟩"
    # A JSON text whose view is no shorter is line work.
    assert run("make", json.dumps({f"key{i}": i for i in range(40)})).label == "passthrough"
    assert run("rg x", "[broken\n" + "step 1\n" * 100).label == "fold-repeats"


def test_the_python_step_needs_no_package_on_the_workers():
    """Unpickled where this library cannot be imported, as on an executor."""
    import base64
    import subprocess
    import sys

    from pyspark import cloudpickle
    from pyspark.sql import functions as functions_module

    caught = []
    original = functions_module.pandas_udf
    functions_module.pandas_udf = lambda kind: lambda f: caught.append(f) or (lambda column: column)
    try:
        from logsift.functions.jsonview import json_view

        json_view(F.lit("[1]"))
    finally:
        functions_module.pandas_udf = original
    code = base64.b64encode(cloudpickle.dumps(caught[0])).decode()
    script = f"import base64, pickle, pandas as pd; print(pickle.loads(base64.b64decode('{code}'))(pd.Series(['[1]', None])).tolist())"
    done = subprocess.run([sys.executable, "-c", script], cwd="/", env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert "[\\n  1\\n]" in done.stdout, done.stderr


def test_user_rules_and_stop(run):
    rules = [
        *BUILTIN_RULES,
        rule("count", "deploy", ("drop_lines", "^noise"), ("replace", [r"(\w+)@(\w+)", r"\2 at \1"]), ("summary", "hid {dropped}, changed {replaced}"), stop=True),
        rule("never", ".*", ("keep_lines", "nothing matches this")),
    ]
    raw = "\n".join(["noise " + w for w in "abcdefghij"] + ["bob@home", "x $1"])
    got = run("DEPLOY now", raw, rules=rules, opts=Options(min_tokens=0, min_saving=0))
    assert got.body == "home at bob\nx $1\nhid 10, changed 1" and got.label == "count"


def test_summary_counts_what_folds_drop(run):
    rules = [rule("all", ".*", ("collapse_repeats", True), ("cascade_guard", 2), ("limit_per_file", 1), ("keep_head_tail", [3, 1]), ("summary", "{dropped} {{x}}"))]
    raw = "\n".join(["step 1"] * 5 + ["a.c:1: p", "a.c:2: q", "a.c:3: r"] + [f"error {i} {w}" for i in range(3) for w in ("up", "down")])
    got = run("x", raw, rules=rules, opts=Options(min_tokens=0, min_saving=0))
    # The run drops 3, two fingerprints 1 each, the file 2, and the ends hide 6 of the 10 lines left.
    assert got.body.split("\n")[-1] == "13 {x}"


def test_odd_inputs(run):
    """Nothing raises: empty text that grows, marker counts beyond 64 bits, half surrogates, NULLs."""
    grow = [rule("sum", ".*", ("summary", "end"))]
    got = run("x", "", rules=grow, opts=Options(min_tokens=0))
    assert (got.body, got.passthrough, got.pct) == ("\nend", False, 0.0)
    huge = "9" * 25
    assert run("x", "a" * 900 + f"… ⟨+{huge} chars⟩", opts=Options(min_saving=0)).body.endswith(f"⟨+{int(huge) + 100} chars⟩")
    assert run("x", json.dumps({"k": ["\ud800"] * 300})).label == "json"
    assert run(None, None).passthrough


def test_broken_rules_are_left_out(run):
    rules = [rule("bad", "(", ("keep_lines", "x")), rule("empty", "", ("keep_lines", "x")), rule("half", ".*", ("drop_lines", "("), ("nonsense", 1), ("drop_lines", "^b"))]
    got = run("x", "a\nb\na", rules=rules, opts=Options(min_tokens=0, min_saving=0))
    assert (got.body, got.label) == ("a\na", "half")


def test_user_filter_comes_first(run):
    first = Filter("mine", r"\bnpm\b", lambda lines, opts: f"slice({lines}, 1, 1)")
    assert run("npm install", "npm warn keep\n" * 50, filters=[first]).body == "npm warn keep"


def test_rule_packs(tmp_path, spark):
    (tmp_path / "b.yaml").write_text("- name: late\n  match: x\n  stop: true\n  actions:\n    - drop_lines: '^y'\n      collapse_repeats: 2\n- 7\n")
    (tmp_path / "a.json").write_text('[{"name": "early", "match": "x", "actions": [{"max_line_len": 9}]}]')
    (tmp_path / "c.yaml").write_text("a: [")
    (tmp_path / "d.yaml").write_text("just: a mapping")
    rules = load_rules(str(tmp_path))
    assert [r.name for r in rules[len(BUILTIN_RULES):]] == ["early", "late"]
    assert rules[-1].actions == (("drop_lines", "^y"), ("collapse_repeats", 2)) and rules[-1].stop
    assert rule_table(spark, rules).filter("kind = 'rule'").count() == 23
    assert rule_from_dict({"match": "x"}).name == "unnamed"
    assert load_rules(str(tmp_path / "none")) == BUILTIN_RULES


def test_replacement_spelling():
    assert java_replacement(r"\1-\g<name>-\g<2>$") == r"$1-${name}-$2\$"


def test_named_groups_and_bad_templates(run):
    swap = [rule("swap", ".*", ("replace", [r"(?P<a_b>\w+)=(?P<c>\w+)", r"\g<c>=\g<a_b>"]), ("replace", ["(x)", r"\2"]), ("replace", ["x"]))]
    assert run("x", "x=1", rules=swap, opts=Options(min_tokens=0, min_saving=-9)).body == "1=x"


def test_a_filter_on_results_does_not_run_the_chain_twice(spark):
    df = spark.createDataFrame([("1", "make", "x")], "id string, command string, raw string")
    plan = compress(df, json=False).filter(~F.col("passthrough"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Filter") < plan.index("Generate") and plan.count("fold-repeats") == 1
    assert "Exchange" not in compress(df, json=False)._jdf.queryExecution().executedPlan().toString()


def chained(spark, rows, size=3, **options):
    """Bodies and labels by the line-table pipeline in blocks of a few lines."""
    from logsift.operators.lines import in_blocks, to_lines
    from logsift.plans.linechain import compress_line_table

    frame = spark.createDataFrame(rows, "id string, command string, raw string")
    done = compress_line_table(in_blocks(to_lines(frame.select("id", "raw")), size).repartition(4), frame.select("id", "command"), **options)
    lines = {}
    for r in sorted(done.bodies.collect(), key=lambda r: (r.block, r.n)):
        lines.setdefault(r.id, []).append(r.line)
    return {r.id: ("\n".join(lines.get(r.id, [""])), r.label, r.raw_tokens, r.comp_tokens, r.saved, round(r.pct, 6), r.passthrough) for r in done.results.collect()}


def in_rows(spark, rows, **options):
    done = compress(spark.createDataFrame(rows, "id string, command string, raw string"), json=False, **options)
    return {r.id: (r.body, r.label, r.raw_tokens, r.comp_tokens, r.saved, round(r.pct, 6), r.passthrough) for r in done.collect()}


LINE_CASES = [
    ("a", "git status", "\n".join(["On branch x", '  (use "git add")', "", "", " ", "end"] * 30)),
    ("b", "pip install z", "\n".join(["Collecting z"] * 40 + ["error: Collecting failed"] + ["Using cached z"] * 9)),
    ("c", "yarn add q", "\n".join(["warning q"] * 50)),
    ("d", "pytest -q", "\n".join(["..F. [ 10%]"] * 30 + ["FAILED t.py"])),
    ("e", "ls -R", "\n".join(f"file-{chr(97 + k % 26)}{'x' * (k % 5)}" for k in range(90))),
    ("f", "cargo build --message-format=json && docker logs api | rg -n x", "\n".join(["   Compiling a v1", '{"reason":"compiler-artifact"}', "  |  ", "err 1", "err 2", "err 3", "src/a.rs:1: hit", "src/a.rs:2: hit", "\x1b[31mred\x1b[0m"] * 12)),
    ("g", "cargo check", "\n".join(["   Compiling part v3"] * 60)),
    ("h", "make", "﻿" + "y" * 3000 + "\n" + "step 5 done\n" * 50),
    ("i", None, "unchanged " * 40),
    ("j", "make", ""),
    ("k", "tail -f log", "\n".join(x for k in range(40) for x in (f"error {k}", f"only {chr(65 + k)}"))),
    ("l", "rg -n call", "\n".join([f"src/s.rs:{k}:  call" for k in range(60)] + ["Binary file matches", "docs/n.md:1: once"])),
    ("m", "make", "﻿short"),
]


def test_line_tables_give_what_rows_give(spark):
    rules = [*BUILTIN_RULES, rule("mask", "make|tail", ("replace", [r"\d+", "#"]), ("max_line_len", 40), stop=True), rule("never", "make", ("keep_lines", "nothing")), rule("keep", "git", ("keep_lines", "branch|end"))]
    for options in ({}, {"opts": Options(min_tokens=0, min_saving=-100)}, {"rules": rules, "opts": Options(min_tokens=0, min_saving=-100)}):
        assert chained(spark, LINE_CASES, **options) == in_rows(spark, LINE_CASES, **options)
    assert chained(spark, LINE_CASES[:0]) == {}
    assert chained(spark, LINE_CASES, rules=[], filters=[]) == in_rows(spark, LINE_CASES, rules=[], filters=[])


def test_line_tables_are_not_kept_pass_by_pass(spark, tmp_path, monkeypatch):
    """What is left on disk are the lines as given and as they come out of the passes, however many passes there are."""
    import pyarrow.parquet as pq

    monkeypatch.setattr("logsift.scratch.folder", lambda spark: str(tmp_path))
    chained(spark, LINE_CASES, opts=Options(min_tokens=0, min_saving=-100))
    lines = sum(raw.count("\n") + 1 for _, _, raw in LINE_CASES)
    tables = [p for p in tmp_path.rglob("*.parquet") if p.is_file() and not p.parts[len(tmp_path.parts)].startswith("keyed-lines")]
    assert 0 < sum(f.metadata.num_rows for f in map(pq.ParquetFile, tables) if "line" in f.schema_arrow.names) <= 2.5 * lines


def test_what_line_tables_cannot_do(spark):
    for bad in (("summary", "x"), ("replace", [r"a\s+b", ""]), ("replace", ["^a", ""]), ("replace", ["[^x]y", ""])):
        with pytest.raises(ValueError):
            chained(spark, LINE_CASES[:1], rules=[rule("r", ".*", bad)])
    with pytest.raises(ValueError):
        chained(spark, LINE_CASES[:1], filters=[Filter("own", ".*", lambda lines, opts: lines)])


def test_routes(spark):
    """The route of a command is the list of rules and the filter that its patterns give one by one, with and without the common test."""
    from logsift.plans.filters import BUILTIN_FILTERS
    from logsift.plans.routing import required_texts, route

    assert required_texts("git (diff|show)") == {"git "} and required_texts(r"\w+") is None and required_texts("a") is None and required_texts("(a|bc)") is None
    commands = ["git DIFF x", "cargo test", "echo hi", "", "rg --files -l", "Get-VM", "sudo apt-get install && git log | tail", "ls", "pip install x; ls", "GIT STATUS", "makeshift", "py"]
    frame = spark.createDataFrame([(c,) for c in commands], "command string")
    stops = [*BUILTIN_RULES[:5], rule("halt", "tail|cargo", ("strip_ansi", True), stop=True), *BUILTIN_RULES[5:], rule("none", "", ("strip_ansi", True)), rule("bad", "(", ("strip_ansi", True))]
    for rules in (BUILTIN_RULES, stops):
        from logsift.plans.filters import filter_name
        from logsift.plans.rules import active_rules

        names = [f.name for f in BUILTIN_FILTERS]
        one_by_one = ", ".join(f"CASE WHEN {hit} THEN {k} END" for k, (_, hit) in enumerate(active_rules(rules, "command"), len(names)))
        got = frame.select(F.expr(route("command", rules, BUILTIN_FILTERS)).alias("route"), F.expr(filter_name("command")).alias("f"), F.expr(f"array_compact(array({one_by_one}))").alias("rules")).collect()
        assert [r.route for r in got] == [([names.index(r.f)] if r.f else []) + r.rules for r in got]
