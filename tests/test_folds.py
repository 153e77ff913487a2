"""Folds against a few lines of plain Python, on made-up texts."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.operators import folds, linefolds
from logsift.operators.lines import in_blocks, to_lines

rng = random.Random(7)
WORDS = [
    "", "  ", "ok", "step 1", "step 2", "step 33 ", "\terror at 0xfe1", "error at 0xFE99", "id 550e8400-e29b-41d4-a716-446655440000",
    "id 650e8400-e29b-41d4-a716-446655440000", "src/a.rs:1:x", "src/a.rs:22:y", "b.md:3:z", "2024-01-01 10:00:00.5 up", "2024-01-02T10:00:01 up",
    "took 5ms", "took 77 ms", "took 7.25kb", "sha deadbeefcafe", "sha 1234567", "sha 123456", "é1 naïve 12", "١٢٣ digits", "tail\r", "x ",
]
TEXTS = ["\n".join(rng.choices(WORDS, k=rng.randint(1, 40))) for _ in range(300)]
TEXTS += ["\n".join(rng.choices(WORDS[:6], k=rng.randint(1, 60))) for _ in range(100)] + ["", "\n", "a\n" * 50]


def plain_fingerprint(line):
    line = line.rstrip()
    for pattern, stand_in in T.VOLATILE:
        line = re.sub(pattern, stand_in, line)
    return line.strip()


def plain_collapse(lines, least):
    out = []
    for fp, run in itertools.groupby(lines, plain_fingerprint):
        run = list(run)
        out += [run[0], f"    … ⟨×{len(run)} similar lines⟩"] if fp and len(run) >= least else run
    return out


def plain_cap(lines, key, keep, marker):
    counts, seen, out = Counter(map(key, lines)), Counter(), []
    for line in lines:
        k = key(line)
        seen[k] += 1
        if not k or seen[k] <= keep:
            out.append(line)
        elif seen[k] == keep + 1:
            out.append(marker(k, counts[k] - keep))
    return out


def plain_file(line):
    found = re.match(r"([^\s:][^:]*):\d+:", line)
    return found and found[1]


def plain_ends(lines, head, tail):
    if len(lines) <= head + tail + 1:
        return lines
    return lines[:head] + [f"… ⟨{len(lines) - head - tail} lines hidden⟩"] + lines[len(lines) - tail:]


CASES = {
    "collapse-3": (lambda ls: folds.collapse_repeats(folds.with_fingerprints(ls), 3), lambda ls: plain_collapse(ls, 3)),
    "collapse-2": (lambda ls: folds.collapse_repeats(folds.with_fingerprints(ls), 2), lambda ls: plain_collapse(ls, 2)),
    "cascade": (
        lambda ls: folds.cascade_guard(folds.with_fingerprints(ls), 2),
        lambda ls: plain_cap(ls, plain_fingerprint, 2, lambda _, n: f"    … ⟨and {n} more like this⟩"),
    ),
    "per-file": (
        lambda ls: folds.limit_per_file(folds.with_fingerprints(ls), 3),
        lambda ls: plain_cap(ls, plain_file, 3, lambda k, n: f"    … ⟨+{n} more in {k}⟩"),
    ),
    "ends": (lambda ls: folds.keep_ends(folds.with_fingerprints(ls), 5, 3, kind=folds.Printed), lambda ls: plain_ends(ls, 5, 3)),
    "ends-0": (lambda ls: folds.keep_ends(folds.with_fingerprints(ls), 0, 0, kind=folds.Printed), lambda ls: plain_ends(ls, 0, 0)),
}


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, raw string").repartition(8).cache()


@pytest.mark.parametrize("name", CASES)
def test_fold_in_rows(texts, name):
    fold, plain = CASES[name]
    kept = f"transform({fold(T.split_lines('raw'))}, x -> x.line)"
    for row in texts.select("id", F.expr(kept).alias("kept")).collect():
        assert row.kept == plain(TEXTS[row.id].split("\n")), TEXTS[row.id]


def test_fingerprint_follows_every_changed_line(texts):
    folded = folds.cascade_guard(folds.collapse_repeats(folds.with_fingerprints(T.split_lines("raw")), 2), 2)
    for row in texts.select(F.expr(folded).alias("items")).collect():
        for item in row["items"]:
            assert item.fp == plain_fingerprint(item.line)


def test_folding_twice_changes_nothing(texts):
    once = folds.collapse_repeats(folds.with_fingerprints(T.split_lines("raw")), 3)
    both = texts.select(F.expr(once).alias("a")).select("a", F.expr(folds.collapse_repeats("a", 3)).alias("b"))
    # A marker can end up next to a like marker only if nothing but the fold put it there.
    assert all(r.a == r.b for r in both.collect() if not _neighbouring_markers(r.a))


def _neighbouring_markers(items):
    return any(a.fp == b.fp and "⟨×" in a.line for a, b in zip(items, items[1:]))


LINE_CASES = {
    "collapse-3": lambda df: linefolds.collapse_repeats(df, 3),
    "collapse-2": lambda df: linefolds.collapse_repeats(df, 2),
    "cascade": lambda df: linefolds.cascade_guard(df, 2),
    "per-file": lambda df: linefolds.limit_per_file(df, 3),
    "ends": lambda df: linefolds.keep_ends(df, 5, 3),
    "ends-0": lambda df: linefolds.keep_ends(df, 0, 0),
}


@pytest.mark.parametrize("name", LINE_CASES)
def test_fold_on_lines(texts, name):
    """Blocks of four lines, so nearly every run and key crosses an edge."""
    _, plain = CASES[name]
    got: dict[int, list] = {}
    for row in LINE_CASES[name](in_blocks(to_lines(texts), 4)).collect():
        got.setdefault(row.id, []).append((row.block, row.n, row.line))
    for i, text in enumerate(TEXTS):
        assert [line for _, _, line in sorted(got[i])] == plain(text.split("\n"))


def one(spark, expression, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(F.expr(expression).alias("v")).first().v


@pytest.mark.parametrize("line", ["x" * 1000, "x" * 300, "x" * 301, "x" * 5 + "… ⟨+9 chars⟩", "y" * 400 + "… ⟨+50 chars⟩", "🙂" * 400])
def test_clip_adds_up(spark, line):
    def plain(text, width):
        found = re.search(r"… ⟨\+(\d+) chars⟩$", text)
        body, already = (text[: found.start()], int(found[1])) if found else (text, 0)
        return text if len(body) <= width else body[:width] + f"… ⟨+{len(body) - width + already} chars⟩"

    twice = T.let(T.clip("line", 350), lambda once: T.clip(once, 300))
    assert one(spark, twice, line=line) == plain(plain(line, 350), 300)


@pytest.mark.parametrize("text", ["", "a", "ab", "a" * 10, "a" * 14, "a" * 17, "é" * 18])
def test_tokens(spark, text):
    assert one(spark, T.tokens("text"), text=text) == (max(1, round(len(text) / 4)) if text else 0)


@pytest.mark.parametrize(
    "spec, want", [("2-3", "bc"), ("2-", "bcde"), ("-2", "ab"), ("4", "d"), ("9-", ""), ("0", ""), ("x", "abcde"), ("", "abcde"), ("3-2", "")]
)
def test_slice(spark, spec, want):
    lines = T.slice_lines("split('a,b,c,d,e', ',')", spec)
    assert one(spark, f"array_join({lines}, '')") == want


def test_bom_ansi_snippet(spark):
    assert one(spark, T.strip_bom("t"), t="﻿﻿a﻿") == "a﻿"
    assert one(spark, T.strip_ansi("t"), t="\x1b[1;31mred\x1b[0m \x1b[2Kx") == "red x"
    assert one(spark, T.snippet("t", 5), t=" a \t\n b c  d") == "a b c"


@pytest.mark.parametrize("value", ["", "it's", "a\\b\\", "${spark.app.name}", "$1", "\n\r\t", "⟨é🙂⟩", "\\u0041", "%_", '"q"'])
def test_literals(spark, value):
    assert one(spark, T.lit(value)) == value


def test_capped_lines_are_keyed_once(spark):
    rows = [("a", k // 8, k, "" if k % 5 == 0 else f"step {k} of {k % 3}") for k in range(40)] + [("b", 0, 0, "one"), ("b", 0, 1, "")]
    lines = spark.createDataFrame(rows, "id string, block long, n long, line string")
    capped = linefolds.cascade_guard(lines, 3, made=True)
    assert "regexp_replace" not in capped._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.n, r.line, r.made) for r in capped.collect() if r.id == "a")
    want = plain_cap([x[3] for x in rows if x[0] == "a"], lambda line: plain_fingerprint(line) or None, 3, lambda _, more: f"    … ⟨and {more} more like this⟩")
    assert [line for _, line, _ in got] == want and sum(made for *_, made in got) == 1
    assert linefolds.cascade_guard(lines, 0).count() == linefolds.cascade_guard(lines, 0, made=True).where("made").count()
