"""Filters, rules and the valve on tables of lines: the pipeline for outputs larger than a row.

Every output has a program: the steps of its filter and its rules, found once per command. A pass takes each output through all steps on
single lines up to, and with, its next fold over several lines. So there are as many passes as the longest program has folds, however
many rules there are, and in a pass all outputs with one kind of fold are folded together. Folds work in blocks and carry one state per
block over its edges (``linefolds``); what a layer changed is noted per output; sizes for the valve are summed per block, then per
output. No step brings the lines of one output together. Passes are written, so that a lost executor costs one of them: the folds of one
and the single lines of the next as one table, of which the lines that go on are deleted when the next is there. Outputs meet their program
once; after that, lines carry its number.

What is not done to outputs of this size: the JSON view, which needs the document as a whole; ``summary`` actions; and ``replace`` with a
pattern that may span lines or ask where the text begins or ends. Rules and filters with those raise ``ValueError``.

Defined results: an output without a row in ``commands`` has no command. A NULL line is empty. An output that loses all its lines has an
empty body of one empty line. Lines of equal ``block`` and ``n`` stay in an undefined order. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.functions.patterns import java_pattern, readable
from logsift.functions.text import ANY_CASE, UNICODE, let, lit, search
from logsift.operators import linefolds
from logsift.operators.ordered import checked_join, sized_join
from logsift.options import DEFAULTS, Options
from logsift.plans import filters as families
from logsift.plans.filters import BUILTIN_FILTERS, Filter
from logsift.plans.routing import layer_names, route
from logsift.plans.rules import BUILTIN_RULES, Rule, group_size, java_replacement, repeats, replaceable
from logsift.scratch import delete, new_path, saved

LINE = ["id", "block", "n", "line"]
PACKED = "zstd"  # for tables as large as the lines


@dataclass(frozen=True)
class Step:
    """One action of a layer. ``line`` and ``drops`` are SQL, with NUL for the line; a step with ``fold`` works on several lines."""

    layer: int
    line: str | None = None  # the line after it
    drops: str | None = None  # does the line go?
    fold: tuple[Any, ...] | None = None


@dataclass(frozen=True)
class LineResults:
    results: DataFrame  # id, raw_tokens, comp_tokens, saved, pct, label, passthrough
    bodies: DataFrame  # id, block, n, line


def spans_lines(pattern: str) -> bool:
    """May the pattern match a line end, or ask where the text begins or ends?"""

    def inside(parsed) -> bool:
        for op, arg in parsed:
            name = str(op)
            if name in ("AT", "ASSERT", "ASSERT_NOT", "GROUPREF_EXISTS") and not (name == "AT" and "BOUNDARY" in str(arg)):
                return True
            if name == "NOT_LITERAL" or name == "LITERAL" and arg == 10:
                return True
            if name == "IN" and any(str(k) in ("NEGATE", "CATEGORY") and str(v) != "CATEGORY_DIGIT" and str(v) != "CATEGORY_WORD" or str(k) == "RANGE" and v[0] <= 10 <= v[1] or (str(k), v) == ("LITERAL", 10) for k, v in arg):
                return True
            parts = arg[1] if name == "BRANCH" else [arg[-1]] if name in ("SUBPATTERN", "MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT", "ATOMIC_GROUP") else []
            if any(inside(p) for p in parts):
                return True
        return False

    try:
        parsed = re._parser.parse(pattern)
    except re.error:
        return True
    return bool(parsed.state.flags & (re.DOTALL | re.MULTILINE)) or inside(parsed)


def _action(layer: int, kind: str, arg: Any, opts: Options) -> Step | None:
    """A rule's action as a step; None if it is off or unreadable."""
    if kind == "strip_ansi" and arg:
        return Step(layer, line=f"CASE WHEN contains(\0, '\\u001b') THEN {T.strip_ansi(chr(0))} ELSE \0 END")
    if kind in ("drop_lines", "keep_lines") and readable(arg):
        found = search("\0", UNICODE + java_pattern(arg))
        return Step(layer, drops=found if kind == "drop_lines" else f"NOT {found}")
    if kind == "replace" and replaceable(arg):
        if spans_lines(arg[0]):
            raise ValueError(f"the pattern {arg[0]!r} of a replace action may span lines")
        return Step(layer, line=T.substitute("\0", UNICODE + java_pattern(arg[0]), java_replacement(arg[1])))
    if kind == "max_line_len":
        return Step(layer, line=T.clip("\0", int(arg)))
    if kind == "collapse_repeats" and arg:
        return Step(layer, fold=("collapse", repeats(arg, opts)))
    if kind == "cascade_guard" and arg:
        return Step(layer, fold=("cascade", group_size(arg)))
    if kind == "limit_per_file" and arg:
        return Step(layer, fold=("limit", group_size(arg)))
    if kind == "keep_head_tail" and isinstance(arg, (list, tuple)) and len(arg) == 2:
        return Step(layer, fold=("ends", int(arg[0]), int(arg[1]), "lines"))
    if kind == "summary" and isinstance(arg, str):
        raise ValueError("summary actions need the output as a whole")
    return None


def _filter_steps(layer: int, chosen: Filter, opts: Options) -> list[Step]:
    """The built-in filters as steps."""
    ends = lambda what: Step(layer, fold=("ends", opts.keep_head, opts.keep_tail, what))
    if chosen.run is families.git_status:
        return [Step(layer, drops=search("\0", UNICODE + families.GIT_HINT)), Step(layer, fold=("blanks",)), ends("status lines")]
    if chosen.run is families.pip_install:
        noise = f"{search('line', ANY_CASE + families.PIP_NOISE)} AND NOT contains(lower(line), 'error')"
        return [Step(layer, fold=("count", noise, "pip progress lines"))]
    if chosen.run is families.npm_install:
        start = " OR ".join(f"startswith({T.strip('lower(line)')}, {lit(p)})" for p in families.NPM_NOISE)
        return [Step(layer, fold=("count", start, "npm warn/notice lines"))]
    if chosen.run is families.pytest_run:
        return [Step(layer, drops=search("\0", UNICODE + families.PYTEST_PROGRESS))]
    if chosen.run is families.dir_listing:
        return [ends("entries")]
    raise ValueError(f"filter {chosen.name!r} works on whole outputs")


def steps_of(rules: Sequence[Rule], filters: Sequence[Filter], opts: Options) -> list[Step]:
    """All steps in order, those of a layer next to one another."""
    steps = [s for k, f in enumerate(filters) for s in _filter_steps(k, f, opts)]
    actions = [(k, *action) for k, r in enumerate(rules, len(filters)) for action in r.actions]
    return steps + [s for k, kind, arg in actions if (s := _action(k, kind, arg, opts))]


def _programs(commands: DataFrame, steps: Sequence[Step], rules: Sequence[Rule], filters: Sequence[Filter]) -> DataFrame:
    """``id, steps: array<struct<step, pass>>``: what is done to an output, and in which pass."""
    by_layer = [[s for s, step in enumerate(steps) if step.layer == layer] for layer in range(len(rules) + len(filters))]
    table = f"array({', '.join(f'CAST(array({', '.join(map(str, held))}) AS ARRAY<INT>)' for held in by_layer)})" if by_layer else "CAST(array() AS ARRAY<ARRAY<INT>>)"
    folds = f"array({', '.join('1' if s.fold else '0' for s in steps)})" if steps else "CAST(array() AS ARRAY<INT>)"
    known = commands.groupBy("id").agg(F.coalesce(F.min("command"), F.lit("")).alias("command"))
    routed = known.select("id", F.expr(route("command", rules, filters)).alias("layers"))
    listed = routed.select("id", F.expr(f"flatten(transform(layers, k -> {table}[k]))").alias("steps"))
    earlier = f"aggregate(slice(steps, 1, i), 0, (a, x) -> a + {folds}[x])"
    return listed.select("id", F.expr(f"transform(steps, (s, i) -> named_struct('step', s, 'pass', {earlier}))").alias("steps"))


def _single_lines(rows: DataFrame, steps: Sequence[Step], numbers: Sequence[int]) -> DataFrame:
    """Steps on single lines, each where it is in the row's ``now``. ``line`` is NULL once it went; ``marks`` gets the layers that changed it."""
    rows = rows.withColumn("state", F.expr("named_struct('line', line, 'marks', marks)"))
    for number in numbers:
        step = steps[number]

        def changed(s: str, new: str, layer: int = step.layer) -> str:
            return f"named_struct('line', {new}, 'marks', array_union({s}.marks, array({layer})))"

        def one(s: str, step: Step = step, number: int = number) -> str:
            if step.drops:
                hit = step.drops.replace("\0", f"{s}.line")
                return f"CASE WHEN array_contains(now, {number}) AND {hit} THEN {changed(s, 'CAST(NULL AS STRING)')} ELSE {s} END"
            new = step.line.replace("\0", f"{s}.line")
            return let(f"CASE WHEN array_contains(now, {number}) THEN {new} END", lambda x: f"CASE WHEN {x} != {s}.line THEN {changed(s, x)} ELSE {s} END")

        rows = rows.withColumn("state", F.expr(let("state", one)))
    return rows.select("id", "program", "block", "n", F.col("state.line").alias("line"), F.col("state.marks").alias("marks"), "fold")


def _parted(pieces: list[DataFrame], name: str) -> tuple[DataFrame, str]:
    """The rows written with their ``part``: lines that are ``gone``, those that are ``done`` and those that go ``on`` to a fold. And the folder.

    One piece after the other, so that the disk holds what one kind of fold shuffles at a time.
    """
    path = new_path(pieces[0].sparkSession, name)
    for rows in pieces:
        rows = rows.withColumn("part", F.when(F.col("line").isNull(), "gone").when(F.col("fold").isNull(), "done").otherwise("on"))
        rows.write.partitionBy("part").parquet(path, mode="append", compression=PACKED)
    return rows.sparkSession.read.schema(rows.schema).parquet(path), path


def _folded(rows: DataFrame, fold: tuple[Any, ...]) -> DataFrame:
    """``id, block, n, line, made`` after one kind of fold; ``made`` says that a line tells of a change."""
    kind, *args = fold
    if kind == "collapse":
        return linefolds.collapse_repeats(rows, *args, made=True)
    if kind == "cascade":
        return linefolds.cascade_guard(rows, *args, made=True)
    if kind == "limit":
        return linefolds.limit_per_file(rows, *args, made=True)
    if kind == "ends":
        return linefolds.keep_ends(rows, *args, made=True)
    if kind == "count":
        return linefolds.count_dropped(rows, F.expr(args[0]), args[1])
    again = linefolds.squeeze_blanks(rows, F.expr(f"{T.strip('line')} = ''"))
    return again.select("id", "block", "n", F.when(~F.col("again"), F.col("line")).alias("line"), F.col("again").alias("made"))


def compress_line_table(
    lines: DataFrame, commands: DataFrame, opts: Options = DEFAULTS, rules: Sequence[Rule] = BUILTIN_RULES, filters: Sequence[Filter] = BUILTIN_FILTERS
) -> LineResults:
    """Compress outputs given as ``lines`` (``id, block, n, line``) and ``commands`` (``id, command``)."""
    filters = list(filters)
    steps = steps_of(rules, filters, opts)
    given = saved(lines.where("id is not null").select("id", "block", "n", F.coalesce("line", F.lit("")).alias("line")), "lines", PACKED)
    # Sizes and the place of the first line, per block and then per output.
    sums = given.groupBy("id", "block").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("line")).alias("chars"), F.min_by(F.struct("block", "n", F.startswith("line", F.lit("﻿")).alias("bom")), "n").alias("first"))
    raw = saved(sums.groupBy("id").agg(F.sum("rows").alias("rows"), F.sum("chars").alias("chars"), F.min_by("first", "block").alias("first")), "raw-sizes")
    programs = saved(_programs(raw.select("id").join(commands.select("id", "command"), "id", "left"), steps, rules, filters), "programs")
    # A row for each different program; its number is fixed when it is written.
    kinds = saved(programs.select("steps").distinct().select("steps", F.monotonically_increasing_id().alias("program")), "kinds")
    own = saved(checked_join(programs, kinds, ["steps"], F.col("id")).join(raw, "id").select("id", "rows", "first", "program"), "own")
    passes = kinds.select(F.explode("steps").alias("s")).groupBy("s.pass").agg(F.collect_set("s.step").alias("steps")).orderBy("pass").collect()  # a row for each pass
    layer_of = F.element_at(F.lit([s.layer for s in steps] or [0]), F.col("fold") + 1)
    unmarked = F.expr("CAST(array() AS ARRAY<INT>)")

    spark, done, marks, before = given.sparkSession, [], [], ""
    first = F.col("first.bom") & (F.col("block") == F.col("first.block")) & (F.col("n") == F.col("first.n"))
    work = [sized_join(given, own, ["id"], "rows", F.struct("block", "n")).select(
        "id", "program", "block", "n", F.when(first, F.expr(T.strip_bom("line"))).otherwise(F.col("line")).alias("line"), unmarked.alias("marks")
    )]

    def written(pieces: list[DataFrame]) -> DataFrame:
        """Writes a pass; what the pass before handed on to it is deleted."""
        nonlocal before
        rows, path = _parted(pieces, "lines-after")
        done.append(rows.where("part = 'done'").select(*LINE))
        marks.append(saved(rows.where("size(marks) > 0").select("id", F.explode("marks").alias("layer")).distinct(), "marks"))
        if before:
            delete(spark, f"{before}/part=on")
        before = path
        return rows.where("part = 'on'")

    for number, row in enumerate(passes):
        chosen = sorted(row["steps"])
        now = F.expr(f"transform(filter(steps, s -> s.pass = {number}), s -> s.step)")
        folds = [s for s in chosen if steps[s].fold]
        fold = F.filter("now", lambda s: s.isin(folds) if folds else F.lit(False))
        todo = saved(kinds.select("program", now.alias("now")).select("program", "now", F.get(fold, F.lit(0)).alias("fold")), "pass")
        alone = [s for s in chosen if not steps[s].fold]
        left = written([_single_lines(checked_join(rows, todo, ["program"], F.struct("block", "n")), steps, alone) for rows in work])
        by_kind: dict[tuple, list[int]] = {}
        for s in folds:
            by_kind.setdefault(steps[s].fold, []).append(s)
        # The fold's number travels with the id, to name the layer of what it made; so does the program's.
        marked = F.when(F.col("made"), F.array(layer_of)).otherwise(unmarked).alias("marks")
        work = []
        for kind, held in by_kind.items():
            rows = _folded(left.where(F.col("fold").isin(held)).select(F.struct("id", "fold", "program").alias("id"), "block", "n", "line"), kind)
            work.append(rows.select("id.id", "id.program", "id.fold", "block", "n", "line", "made").select("id", "program", "block", "n", "line", marked))
        if not work:
            break
    if passes and work:
        written([rows.withColumn("fold", F.lit(None).cast("int")) for rows in work])

    body = done[0] if done else given
    for piece in done[1:]:
        body = body.union(piece)
    return _judged(given, raw, body, marks, opts, layer_names(rules, filters))


def _judged(given: DataFrame, raw: DataFrame, body: DataFrame, marks: list[DataFrame], opts: Options, names: list[str]) -> LineResults:
    """The valve, and what is shown."""
    after = body.groupBy("id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("c")).groupBy("id").agg(F.sum("n").alias("after_rows"), F.sum("c").alias("after_chars"))
    noted = given.select("id", F.lit(0).alias("layer")).limit(0)
    for piece in marks:
        noted = noted.union(piece)
    noted = noted.groupBy("id").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    size = lambda rows, chars: f"greatest(0L, coalesce({chars}, 0L) + coalesce({rows}, 0L) - 1)"
    token = lambda n: f"CASE WHEN {n} = 0 THEN 0L ELSE greatest(1L, bigint(rint({n} / 4.0D))) END"
    label = F.array_join(F.transform("layers", lambda k: F.element_at(F.lit(names or [""]), k + 1)), "+")
    found = raw.join(after, "id", "left").join(noted, "id", "left")
    found = found.select("id", "rows", F.expr(token(size("rows", "chars"))).alias("before"), F.expr(token(size("after_rows", "after_chars"))).alias("after"), F.coalesce(label, F.lit("none")).alias("named"), (F.col("layers").isNotNull() | F.col("first.bom")).alias("changed"))
    through = f"before < {opts.min_tokens} OR NOT changed OR (before - after) / nullif(before, 0) < {opts.min_saving}D"
    judged = saved(found.withColumn("passthrough", F.expr(f"coalesce({through}, false)")), "judged")
    results = judged.selectExpr(
        "id", "before AS raw_tokens", "CASE WHEN passthrough THEN before ELSE after END AS comp_tokens", "CASE WHEN passthrough THEN 0L ELSE before - after END AS saved",
        "CASE WHEN passthrough OR before = 0 THEN 0.0D ELSE (before - after) / before * 100 END AS pct", "CASE WHEN passthrough THEN 'passthrough' ELSE named END AS label", "passthrough",
    )
    which = judged.select("id", "passthrough", "rows")
    salt = F.struct("block", "n")
    shown = sized_join(given, which, ["id"], "rows", salt, "inner").where("passthrough").select(*LINE)
    cut = sized_join(body, which, ["id"], "rows", salt, "inner").where("not passthrough").select(*LINE)
    return LineResults(results, shown.union(cut))
