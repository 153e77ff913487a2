"""Filters made for one family of commands. They run before the rules; the first that matches wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from logsift.functions.patterns import java_pattern, readable
from logsift.functions.text import ANY_CASE, UNICODE, fn, let, lit, search, strip
from logsift.operators import folds
from logsift.options import DEFAULTS, Options


@dataclass(frozen=True)
class Filter:
    """``run(lines, options)`` maps an expression for an array of lines to another such expression."""

    name: str
    match: str
    run: Callable[[str, Options], str]


def _drop_and_count(lines: str, noise: Callable[[str], str], what: str) -> str:
    def counted(kept: str) -> str:
        marker = f"concat('… ⟨', string(size({lines}) - size({kept})), ' {what} hidden⟩')"
        return f"CASE WHEN size({kept}) < size({lines}) THEN concat({kept}, array({marker})) ELSE {lines} END"

    return let(f"filter({lines}, {fn(lambda l: f'NOT ({noise(l)})')})", counted)


def git_status(lines: str, opts: Options) -> str:
    told = f"filter({lines}, {fn(lambda l: f'NOT {search(l, UNICODE + GIT_HINT)}')})"
    squeezed = folds.squeeze_blanks(told, lambda l: f"{strip(l)} = ''")
    return folds.keep_ends(squeezed, opts.keep_head, opts.keep_tail, "status lines")


# How the lines that can go look.
GIT_HINT = r"^\s*\(use "
PIP_NOISE = (
    r"^(Requirement already satisfied|"
    r"\s*(Downloading|Using cached|Collecting|Obtaining|Getting|Preparing metadata"
    r"|Building wheel|Created wheel|Stored in directory|WARNING: ))"
)
NPM_NOISE = ["npm warn", "npm notice", "warning ", "warning:"]
PYTEST_PROGRESS = r"^[\s.sFExXpP]+\[\s*\d+%\]\s*$"


def pip_install(lines: str, opts: Options) -> str:
    def noise(line: str) -> str:
        return f"{search(line, ANY_CASE + PIP_NOISE)} AND NOT contains(lower({line}), 'error')"

    return _drop_and_count(lines, noise, "pip progress lines")


def npm_install(lines: str, opts: Options) -> str:
    def noise(line: str) -> str:
        return let(
            strip(f"lower({line})"), lambda start: " OR ".join(f"startswith({start}, {lit(p)})" for p in NPM_NOISE)
        )

    return _drop_and_count(lines, noise, "npm warn/notice lines")


def pytest_run(lines: str, opts: Options) -> str:
    return f"filter({lines}, {fn(lambda l: f'NOT {search(l, UNICODE + PYTEST_PROGRESS)}')})"


def dir_listing(lines: str, opts: Options) -> str:
    return folds.keep_ends(lines, opts.keep_head, opts.keep_tail, "entries")


# Which commands each filter is for.
BUILTIN_FILTERS = [
    Filter("git-status", r"\bgit\s+status\b", git_status),
    Filter("pip-install", r"\bpip\d?\s+install\b|\bpython\s+-m\s+pip\s+install\b", pip_install),
    Filter(
        "npm-install", r"\bnpm\s+(install|ci|i)\b|\byarn\s+(install|add)\b|\bpnpm\s+(install|i|add)\b", npm_install
    ),
    Filter("pytest", r"\bpytest\b|\bpy\.test\b|\bpython\s+-m\s+pytest\b", pytest_run),
    Filter("dir-listing", r"\b(ls|dir|ll)\b", dir_listing),
]


def filter_name(command: str, filters: Sequence[Filter] = BUILTIN_FILTERS) -> str:
    """Name of the first filter whose pattern occurs in the command, NULL for none."""
    filters = [f for f in filters if readable(f.match)]
    if not filters:
        return "CAST(NULL AS STRING)"
    cases = " ".join(f"WHEN {search(command, ANY_CASE + java_pattern(f.match))} THEN {lit(f.name)}" for f in filters)
    return f"CASE {cases} END"


def apply_filter(lines: str, name: str, opts: Options = DEFAULTS, filters: Sequence[Filter] = BUILTIN_FILTERS) -> str:
    """Lines after the filter called ``name``; other outputs are left alone."""
    if not filters:
        return lines
    cases = " ".join(
        f"WHEN {name} = {lit(f.name)} THEN {folds.at_least_one(f.run(lines, opts), folds.Plain)}" for f in filters
    )
    return f"CASE {cases} ELSE {lines} END"
