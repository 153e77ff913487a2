"""Which filter and rules a command gets, found once per command instead of once per rule and row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import TYPE_CHECKING

from logsift.functions.patterns import java_pattern, readable
from logsift.functions.text import ANY_CASE, lit, search

if TYPE_CHECKING:
    from logsift.plans.filters import Filter
    from logsift.plans.rules import Rule

_LEAST = 2  # a required text of fewer characters excludes next to nothing


def _longest(texts: list[frozenset[str]]) -> frozenset[str] | None:
    """Of several sets of texts, each of which a match has one of, the one whose shortest text is longest."""
    return max(texts, key=lambda t: (min(map(len, t)), -len(t)), default=None)


def _required(parsed) -> frozenset[str] | None:
    """Texts of which every match of a parsed pattern holds at least one; None if that cannot be told."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = None
        if name == "SUBPATTERN" and not (arg[1] or arg[2]):
            inner = _required(arg[3])
        elif name == "BRANCH":
            parts = [_required(x) for x in arg[1]]
            inner = frozenset().union(*parts) if all(parts) else None
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] > 0:
            inner = _required(arg[2])
        if inner:
            found.append(inner)
    return _longest(found)


def required_texts(pattern: str) -> frozenset[str] | None:
    """Texts (in lower case) of which every match of the pattern holds one in some case, if that can be told and says something."""
    try:
        found = _required(re._parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError, OverflowError):
        return None
    # Letters whose case folding leaves ASCII or changes their number are left to the pattern itself.
    if not found or min(map(len, found)) < _LEAST or not all(t.isascii() for t in found):
        return None
    return frozenset(t.lower() for t in found)


def everywhere(pattern: str) -> bool:
    """Does the pattern match every text?"""
    return pattern in (".*", "", "(?:)")


def matches(rule_: Rule, command: str) -> str:
    """Does the rule's pattern occur in the command, in any case? No or a broken pattern: never."""
    if not rule_.match or not readable(rule_.match):
        return "false"
    return f"coalesce({search(command, ANY_CASE + java_pattern(rule_.match))}, false)"


def route(command: str, rules: Sequence[Rule], filters: Sequence[Filter]) -> str:
    """SQL of an ``array<int>``: the numbers of the layers that apply to a command, in their order.

    Layers are the filters, of which the first that matches counts, and then the rules, as far as no rule before stopped the chain. One
    pattern made of the texts that the others require is tried first: a command with none of them gets the rules for any command at once.
    """
    kinds = [f for f in filters if readable(f.match)]
    choices = [(filters.index(f), f.match) for f in kinds]
    asked = [r.match for r in rules if r.match and readable(r.match) and not everywhere(r.match)] + [m for _, m in choices]
    texts = [required_texts(m) for m in asked]

    def layers(some: bool) -> str:
        picked = " ".join(f"WHEN {search(command, ANY_CASE + java_pattern(m))} THEN {k}" for k, m in choices)
        first = [f"CASE {picked} END"] if choices and some else []
        stops, rest = [], []
        for k, r in enumerate(rules, len(filters)):
            always = bool(r.match) and everywhere(r.match)
            if not always and not some:
                continue
            hit = "true" if always else matches(r, command)
            rest.append(f"CASE WHEN {hit}{''.join(f' AND NOT {s}' for s in stops)} THEN {k} END")
            if r.stop:
                stops.append(f"({hit})")
        return f"array_compact(array({', '.join([*first, *rest])}))" if first or rest else "CAST(array() AS ARRAY<INT>)"

    if not asked or not all(texts):
        return layers(True)
    any_text = "|".join(re.escape(t).replace(r"\ ", " ").replace(r"\-", "-") for t in sorted(frozenset().union(*texts)))
    return f"CASE WHEN {search(command, f'{ANY_CASE}(?:{any_text})')} THEN {layers(True)} ELSE {layers(False)} END"


def on_route(column: str, layer: int) -> str:
    return f"array_contains({column}, {layer})"


def layer_names(rules: Sequence[Rule], filters: Sequence[Filter]) -> list[str]:
    return [f.name for f in filters] + [r.name for r in rules]


def names_of(layers: str, names: Sequence[str]) -> str:
    """SQL: the names of an array of layer numbers."""
    known = f"array({', '.join(map(lit, names))})"
    return f"transform({layers}, k -> {known}[k])" if names else "CAST(array() AS ARRAY<STRING>)"
