"""Rules: which commands they are for and what they do to the lines of an output.

A rule is data. ``apply_rules`` turns a list of rules into narrow projections, guarded per row by the
rule's command pattern, so any number of rules is still one pass over the rows and no shuffle.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions import text as T
from logsift.functions.patterns import group_name, java_pattern, readable
from logsift.functions.text import UNICODE, fn, let, lit, search
from logsift.operators import folds
from logsift.options import DEFAULTS, Options
from logsift.plans.routing import matches, route


@dataclass(frozen=True)
class Rule:
    name: str
    match: str
    actions: tuple[tuple[str, Any], ...]
    stop: bool = False


def rule(name: str, match: str, *actions: tuple[str, Any], stop: bool = False) -> Rule:
    return Rule(name, match, tuple(actions), stop)


# The built-in rules, in the order they apply.
BUILTIN_RULES = [
    # any command
    rule("strip-ansi", ".*", ("strip_ansi", True)),
    rule("clip-monster-lines", ".*", ("max_line_len", 800)),
    rule("fold-repeats", ".*", ("collapse_repeats", 4)),
    # version control
    rule(
        "git-diff-metadata",
        "git (diff|show|format-patch)",
        (
            "drop_lines",
            "^(index [0-9a-f]|old mode |new mode |similarity index |dissimilarity index |new file mode |deleted file mode )",
        ),
    ),
    rule("git-log-fold", "git log", ("collapse_repeats", 3)),
    rule(
        "git-fetch-pull",
        "git (fetch|pull|clone|push)",
        ("drop_lines", "^(Receiving objects|Resolving deltas|remote: (Counting|Compressing|Total) )"),
        ("collapse_repeats", 3),
    ),
    # builds
    rule(
        "cargo",
        "cargo (build|run|test|check|clippy)",
        ("drop_lines", r"^\s*(Compiling|Downloaded|Downloading|Updating) "),
        ("collapse_repeats", 3),
    ),
    rule(
        "cargo-json",
        r"cargo .*--message-format[ =]\S*json",
        ("drop_lines", '"reason":"(compiler-artifact|build-script-executed)"'),
        ("collapse_repeats", 3),
    ),
    rule("rustc-diagnostics", r"\b(cargo|rustc)\b", ("drop_lines", r"^\s*\|\s*$"), ("collapse_repeats", 3)),
    rule("make-cmake-ninja", r"\b(make|cmake|ninja|gcc|g\+\+|clang)\b", ("collapse_repeats", 3)),
    rule(
        "docker-build",
        "docker (build|compose|buildx)",
        ("drop_lines", r"^#\d+ (DONE|CACHED|sha256|extracting|resolve )"),
        ("collapse_repeats", 3),
    ),
    rule(
        "webpack-vite",
        r"\b(webpack|vite|tsc|next build|ng build)\b",
        ("drop_lines", r"^\s*(asset|orphan modules|\+ \d+ modules) "),
        ("collapse_repeats", 3),
    ),
    # logs and downloads
    rule(
        "log-streams",
        r"\b(tail|journalctl|dmesg)\b|(docker|kubectl|nomad) logs",
        ("collapse_repeats", 3),
        ("cascade_guard", 5),
        ("keep_head_tail", [15, 60]),
    ),
    rule(
        "curl-wget-progress",
        r"\b(curl|wget)\b",
        ("drop_lines", r"^\s*(\d+\s+\d+\s+\d+|% Total|Dload)"),
        ("collapse_repeats", 3),
    ),
    # remote shells, package managers, scripts
    rule(
        "pkg-freebsd",
        r"\bpkg\b",
        ("drop_lines", r"^\[\d+/\d+\] (Fetching|Extracting|Installing) .*(done|\.\.\.)$"),
        ("drop_lines", r"^\s*\[\d+%\]"),
        ("collapse_repeats", 3),
    ),
    rule(
        "apt-dnf",
        r"\b(apt|apt-get|dnf|yum)\b",
        ("drop_lines", r"^(Get|Hit|Ign):\d+ "),
        ("drop_lines", "^(Preparing to unpack|Unpacking|Selecting previously) "),
        ("collapse_repeats", 3),
    ),
    rule(
        "ssh-noise",
        r"\b(ssh|scp|sftp)\b",
        ("drop_lines", r"^(Warning: Permanently added|Pseudo-terminal will not|Connection to \S+ closed)"),
        ("collapse_repeats", 4),
    ),
    rule(
        "python",
        r"\b(python|python3|py)\b",
        ("drop_lines", r"^\s*(DeprecationWarning|FutureWarning|UserWarning):"),
        ("drop_lines", r"^\s*\d+%\|[█▏▎▍▌▋▊▉ ]+\|"),
        ("collapse_repeats", 4),
    ),
    rule(
        "powershell-tables",
        r"\bGet-(VM|VHD|Disk|Partition|Volume|Service|Process|NetIPAddress|VMSwitch)\b",
        ("drop_lines", r"^\s*-{3,}(\s+-{3,})*\s*$"),
        ("collapse_repeats", 3),
    ),
    # searches
    rule(
        "ripgrep",
        r"\b(rg|ripgrep|grep|ag|ack)\b",
        ("max_line_len", 300),
        ("limit_per_file", 5),
        ("collapse_repeats", 3),
    ),
    rule(
        "ripgrep-file-lists",
        r"\b(rg|ripgrep|grep|fd|find)\b.*(--files-with-matches|--files\b|\s-l\b|\s-L\b)",
        ("collapse_repeats", 4),
    ),
]


def rule_from_dict(entry: dict) -> Rule:
    """One entry of a rule pack: ``name, match, stop, actions`` with one mapping per action."""
    actions = [
        (kind, arg)
        for step in entry.get("actions") or []
        if isinstance(step, dict)
        for kind, arg in step.items()
    ]
    return Rule(str(entry.get("name", "unnamed")), str(entry.get("match") or ""), tuple(actions), bool(entry.get("stop")))


def replaceable(arg: Any) -> bool:
    """A pair of a pattern and a template that only refers to the pattern's groups."""
    if not _is_pair(arg) or not readable(arg[0]):
        return False
    try:
        re.sub(arg[0], arg[1], "")
    except (re.error, TypeError, IndexError, KeyError):
        return False
    return True


def java_replacement(template: str) -> str:
    """``\\1`` and ``\\g<name>`` references in Java's spelling, everything else literal."""
    out = []
    for part in re.split(r"(\\g<\w+>|\\\d{1,2}|\\.)", template):
        if group := re.fullmatch(r"\\g<(\w+)>", part):
            out.append(f"${group[1]}" if group[1].isdigit() else f"${{{group_name(group[1])}}}")
        elif re.fullmatch(r"\\\d{1,2}", part):
            out.append("$" + part[1:])
        else:
            plain = {r"\n": "\n", r"\t": "\t", r"\r": "\r", r"\\": "\\"}.get(part, part)
            out.append(plain.replace("\\", r"\\").replace("$", r"\$"))
    return "".join(out)


def active_rules(rules: Sequence[Rule], command: str) -> list[tuple[Rule, str]]:
    """Each rule with its row condition: it matches and no earlier matching rule stopped the chain."""
    stops, active = [], []
    for r in rules:
        hit = matches(r, command)
        active.append((r, f"{hit} AND NOT ({' OR '.join(stops)})" if stops else hit))
        if r.stop:
            stops.append(hit)
    return active


_COMPARES_FINGERPRINTS = {"collapse_repeats", "cascade_guard"}
_DEFAULT_GROUP_SIZE = 5


def _is_number(arg: Any) -> bool:
    return isinstance(arg, int) and not isinstance(arg, bool)


def repeats(arg: Any, opts: Options) -> int:
    """Least run that a ``collapse_repeats`` action folds."""
    return arg if _is_number(arg) and arg > 1 else opts.collapse_threshold


def group_size(arg: Any) -> int:
    """How many of a group stay."""
    return arg if _is_number(arg) and arg > 0 else _DEFAULT_GROUP_SIZE


def _is_pair(arg: Any) -> bool:
    return isinstance(arg, (list, tuple)) and len(arg) == 2


def _whole_text(items: str, lines: folds.Lines) -> str:
    return T.join_lines(folds.without_fingerprints(items) if lines is folds.Printed else items)


def _step(kind: str, arg: Any, items: str, lines: folds.Lines, opts: Options) -> str:
    """The lines after one action; an action that is off or unreadable leaves them alone."""
    if kind == "strip_ansi" and arg:
        return folds.rewrite_where(items, lines, lambda l: f"contains({l}, '\\u001b')", T.strip_ansi)
    if kind in ("drop_lines", "keep_lines") and readable(arg):
        pattern = UNICODE + java_pattern(arg)
        wanted = (lambda l: f"NOT {search(l, pattern)}") if kind == "drop_lines" else (lambda l: search(l, pattern))
        return folds.at_least_one(folds.keep_where(items, lines, wanted), lines)
    if kind == "replace" and replaceable(arg):
        # The pattern may span lines, so this one works on the whole text.
        whole = T.substitute(_whole_text(items, lines), UNICODE + java_pattern(arg[0]), java_replacement(arg[1]))
        new = T.split_lines(whole)
        return folds.with_fingerprints(new) if lines is folds.Printed else new
    if kind == "collapse_repeats" and arg:
        return folds.collapse_repeats(items, repeats(arg, opts))
    if kind == "cascade_guard" and arg:
        return folds.cascade_guard(items, group_size(arg))
    if kind == "limit_per_file" and arg:
        return folds.limit_per_file(items, group_size(arg), lines)
    if kind == "keep_head_tail" and _is_pair(arg):
        return folds.keep_ends(items, int(arg[0]), int(arg[1]), "lines", lines)
    if kind == "max_line_len":
        width = int(arg)
        return folds.rewrite_where(items, lines, lambda l: f"length({l}) > {width}", lambda l: T.clip(l, width))
    return items


def _dropped(kind: str, arg: Any, before: str, after: str, lines: folds.Lines) -> str:
    """How many lines an action took out, by its own count."""
    fewer = f"(size({before}) - size({after}))"
    if kind in ("drop_lines", "keep_lines") and readable(arg):
        hits = f"size({folds.keep_where(before, lines, lambda l: search(l, UNICODE + java_pattern(arg)))})"
        return hits if kind == "drop_lines" else f"(size({before}) - {hits})"
    if kind == "collapse_repeats" and arg:
        return fewer
    if kind == "keep_head_tail" and _is_pair(arg):
        return f"CASE WHEN {fewer} != 0 THEN {fewer} + 1 ELSE 0 END"
    if kind in ("cascade_guard", "limit_per_file") and arg:
        # One marker per capped group stands for a line that went too. Markers are the elements that
        # the input does not have.
        markers = f"size(filter({after}, {fn(lambda x: f'NOT array_contains({before}, {x})')}))"
        return f"CASE WHEN {after} != {before} THEN {fewer} + {markers} ELSE 0 END"
    return "0"


def _replaced(kind: str, arg: Any, before: str, lines: folds.Lines) -> str:
    if kind == "replace" and replaceable(arg):
        return f"regexp_count({_whole_text(before, lines)}, {lit(UNICODE + java_pattern(arg[0]))})"
    return "0"


def _summary(fmt: str, dropped: str, replaced: str) -> str:
    """``fmt`` with its ``{dropped}`` and ``{replaced}`` filled in; a format with others is kept as it is."""
    known = {"dropped": dropped, "replaced": replaced}
    try:
        parts = list(string.Formatter().parse(fmt))
    except ValueError:
        return lit(fmt)
    if any(name is not None and (name not in known or spec or conv) for _, name, spec, conv in parts):
        return lit(fmt)
    pieces = ["''"]
    for literal, name, _, _ in parts:
        pieces.append(lit(literal))
        if name is not None:
            pieces.append(f"string({known[name]})")
    return f"concat({', '.join(pieces)})"


def run_actions(rule_: Rule, items: str, lines: folds.Lines, opts: Options) -> str:
    """All actions of one rule in order. Counters start at 0 for every rule and are kept only if shown."""
    counted = any(kind == "summary" for kind, _ in rule_.actions)

    def go(left, items, dropped, replaced):
        if not left:
            return items
        (kind, arg), *left = left
        if kind == "summary" and isinstance(arg, str):
            extra = f"transform({T.split_lines(_summary(arg, dropped, replaced))}, {fn(lines.make)})"
            return let(f"concat({items}, {extra})", lambda new: go(left, new, dropped, replaced))

        def after(new):
            if not counted:
                return go(left, new, dropped, replaced)
            return let(
                f"{dropped} + {_dropped(kind, arg, items, new, lines)}",
                lambda d: let(f"{replaced} + {_replaced(kind, arg, items, lines)}", lambda r: go(left, new, d, r)),
            )

        return let(_step(kind, arg, items, lines, opts), after)

    return go(list(rule_.actions), items, "0", "0")


# Rules per projection. Spark resolves one level of nested lambdas per analysis round and stops at 100
# rounds, so a long chain is cut into several projections. They are all narrow.
_RULES_PER_STEP = 2


def state_struct(items: str, names: str) -> str:
    return f"named_struct('items', {items}, 'names', {names})"


def _chain(active: Sequence[tuple[Rule, str]], state: str, lines: folds.Lines, opts: Options) -> str:
    """``struct<items, names>`` after some rules, each under its row condition."""
    if not active:
        return state
    (r, hit), *left = active

    def judged(new: str) -> str:
        names = f"concat({state}.names, array({lit(r.name)}))"
        return f"CASE WHEN {new} != {state}.items THEN {state_struct(new, names)} ELSE {state} END"

    step = f"CASE WHEN {hit} THEN {let(run_actions(r, f'{state}.items', lines, opts), judged)} ELSE {state} END"
    return let(step, lambda s: _chain(left, s, lines, opts))


_LOOPED = {"strip_ansi", "drop_lines", "keep_lines", "collapse_repeats", "cascade_guard", "limit_per_file", "keep_head_tail", "max_line_len"}


def _programs(command: str, rules: Sequence[Rule], first: int, items: str, names: str, opts: Options) -> str:
    """State after the rules from number ``first`` on: every row is taken through the steps of its own rules, one after the other.

    A step's number chooses what it does, so there is one expression for each kind of step, however many rules have it.
    """
    steps = [(r, kind, arg) for r in range(first, len(rules)) for kind, arg in rules[r].actions]
    by_rule = [[s for s, (owner, _, _) in enumerate(steps) if owner == r] for r in range(len(rules))]
    table = f"array({', '.join(f'CAST(array({', '.join(map(str, held))}) AS ARRAY<INT>)' for held in by_rule)})"
    program = f"flatten(transform({route(command, rules, [])}, {fn(lambda r: f'{table}[{r}]')}))"
    kinds: dict[tuple, list[int]] = {}
    for s, (_, kind, arg) in enumerate(steps):
        group = (kind,) if kind in ("drop_lines", "keep_lines", "collapse_repeats") else (kind, repr(arg))
        kinds.setdefault(group, []).append(s)
    of = lambda held: ", ".join(map(str, held))

    def choice(k: str, held: list[int], value: Callable[[Any], str]) -> str:
        return f"CASE {k} {' '.join(f'WHEN {s} THEN {value(steps[s][2])}' for s in held)} END"

    def lines_that(k: str, held: list[int], it: str, kept: bool) -> str:
        known = [s for s in held if readable(steps[s][2])]
        if not known:
            return it
        hit = lambda l: choice(k, known, lambda arg: search(l, UNICODE + java_pattern(arg)))
        wanted = hit if kept else lambda l: f"NOT {hit(l)}"
        left = folds.at_least_one(folds.keep_where(it, folds.Printed, wanted), folds.Printed)
        return left if len(known) == len(held) else f"CASE WHEN {k} IN ({of(known)}) THEN {left} ELSE {it} END"

    def after(it: str, k: str) -> str:
        cases = []
        for (kind, *_), held in kinds.items():
            if kind in ("drop_lines", "keep_lines"):
                new = lines_that(k, held, it, kind == "keep_lines")
            elif kind == "collapse_repeats":
                new = let(choice(k, held, lambda arg: str(repeats(arg, opts)) if arg else "2147483647"), lambda least: folds.collapse_repeats(it, least))
            else:
                new = _step(kind, steps[held[0]][2], it, folds.Printed, opts)
            cases.append(f"WHEN {k} IN ({of(held)}) THEN {new}")
        return f"CASE {' '.join(cases)} ELSE {it} END" if cases else it

    begins, ends = [h[0] for h in by_rule if h], [h[-1] for h in by_rule if h]
    named = f"array({', '.join(lit(rules[owner].name) for owner, _, _ in steps)})"

    def merged(s: str, k: str) -> str:
        def done(new: str, start: str) -> str:
            more = f"CASE WHEN {k} IN ({of(ends)}) AND {new} != {start} THEN concat({s}.names, array({named}[{k}])) ELSE {s}.names END"
            return f"named_struct('items', {new}, 'start', {start}, 'names', {more})"

        began = f"CASE WHEN {k} IN ({of(begins)}) THEN {s}.items ELSE {s}.start END"
        return let(after(f"{s}.items", k), lambda new: let(began, lambda start: done(new, start)))

    if not steps:
        return state_struct(items, names)
    whole = let(items, lambda it: f"aggregate({program}, named_struct('items', {it}, 'start', {it}, 'names', {names}), {fn(merged, 2)})")
    return let(whole, lambda s: state_struct(folds.without_fingerprints(f"{s}.items"), f"{s}.names"))


def apply_rules(
    outputs: DataFrame, command: str, rules: Sequence[Rule] = BUILTIN_RULES, opts: Options = DEFAULTS, state: str = "_state"
) -> DataFrame:
    """Rewrite column ``state``, a ``struct<items array<string>, names array<string>>``.

    ``items`` are the lines of an output, ``names`` the layers that have changed them so far. Rules up to the first that compares
    fingerprints work on bare lines, one after the other. What follows runs as a program per row (``_programs``), unless a rule works on
    the text as a whole or counts.
    """
    kind, active = folds.Plain, active_rules(rules, command)

    def needs_fingerprints(r: Rule) -> bool:
        return any(k in _COMPARES_FINGERPRINTS for k, _ in r.actions)

    def replace_state(expression: str) -> DataFrame:
        return outputs.withColumn(state, F.expr(expression))

    looped = len(rules)
    first = next((k for k, r in enumerate(rules) if needs_fingerprints(r)), looped)
    if all(k in _LOOPED for r in rules[first:] for k, _ in r.actions):
        looped = first
    active = active[:looped]
    while active:
        if kind is folds.Plain and needs_fingerprints(active[0][0]):
            kind = folds.Printed
            outputs = replace_state(state_struct(folds.with_fingerprints(f"{state}.items"), f"{state}.names"))
        size = 1
        while size < min(_RULES_PER_STEP, len(active)):
            if kind is folds.Plain and needs_fingerprints(active[size][0]):
                break
            size += 1
        some, active = active[:size], active[size:]
        outputs = replace_state(let(state, lambda s: _chain(some, s, kind, opts)))
    if looped < len(rules):
        outputs = replace_state(let(state, lambda s: _programs(command, rules, looped, folds.with_fingerprints(f"{s}.items"), f"{s}.names", opts)))
    if kind is folds.Printed:
        outputs = replace_state(state_struct(folds.without_fingerprints(f"{state}.items"), f"{state}.names"))
    return outputs
