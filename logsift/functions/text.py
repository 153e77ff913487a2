"""Expressions over text, lines and arrays of lines.

An output is one row, so its lines stay in that row as an array: splitting, folding and joining are
narrow expressions and the whole rewrite of a corpus needs no shuffle.

Expressions here are SQL text, to be wrapped in ``F.expr``. A rule chain has thousands of nodes; as text
they reach Spark in one call, while every ``Column`` method is a round trip to the JVM.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

# Java reads \d, \s, \b as ASCII and lets $ stop at any line break. These flags give them Unicode
# meaning and make \n the only line break.
UNICODE = "(?dU)"
ANY_CASE = "(?dUi)"
SPACE = r"[\s\x1c-\x1f]"
# Every white space character, by Unicode's own rule.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

# What counts as volatile in a line, most specific first, and its stand-in.
VOLATILE = [
    (r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"(?i)\b[0-9a-f]{40}\b", "<sha1>"),
    (r"(?i)\b[0-9a-f]{64}\b", "<sha256>"),
    (r"(?i)\b[0-9a-f]{7,12}\b", "<hash>"),
    (r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<ts>"),
    (r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<time>"),
    (r"(?i)0x[0-9a-f]+", "<addr>"),
    (r"(?i)\b\d+(?:\.\d+)?(?:ms|s|kb|mb|gb|b)\b", "<size>"),
    (r"\b\d+\b", "<n>"),
]
# Every pattern above needs a digit or seven hex letters in a row.
MAYBE_VOLATILE = r"\d|[0-9a-fA-F]{7}"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
CLIPPED = r"… ⟨\+(\d+) chars⟩$"
HIT = r"^([^\s:][^:]*):\d+:"

_names = itertools.count()


def lit(value: str) -> str:
    """SQL literal of a string."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r")
    # Spark fills in ${...} before it reads the text.
    escaped = escaped.replace("${", "\\u0024{")
    return f"'{escaped}'"


def fn(body: Callable[..., str], arity: int = 1) -> str:
    """SQL lambda with unused variable names."""
    names = [f"_v{next(_names)}" for _ in range(arity)]
    head = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{head} -> {body(*names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A lambda variable is never inlined by the optimizer, so a costly array used many times (or once
    inside another lambda) is still built once.
    """
    return f"transform(array({value}), {fn(body)})[0]"


def search(text: str, pattern: str) -> str:
    return f"{text} rlike {lit(pattern)}"


def substitute(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)})"


def split_lines(text: str) -> str:
    return f"split({text}, '\\n', -1)"


def join_lines(lines: str) -> str:
    return f"array_join({lines}, '\\n')"


def tokens(text: str) -> str:
    """Estimated tokens: a quarter of the characters, halves to even, at least 1 unless empty."""
    return (
        f"CASE WHEN coalesce(length({text}), 0) = 0 THEN 0L "
        f"ELSE greatest(1L, bigint(rint(length({text}) / 4.0D))) END"
    )


def strip_bom(text: str) -> str:
    return f"CASE WHEN startswith({text}, '\ufeff') THEN {substitute(text, r'^\x{FEFF}+', '')} ELSE {text} END"


def strip_ansi(text: str) -> str:
    return substitute(text, ANSI, "")


def strip(text: str) -> str:
    """Drop white space at both ends: all of Unicode's, where ``trim`` alone drops spaces."""
    return f"trim(BOTH {lit(WHITE)} FROM {text})"


def fingerprint(line: str) -> str:
    """The line with its volatile parts replaced, so near-identical lines compare equal.

    The patterns run in order, but a cheap test skips each group of them that cannot match: most lines
    of prose need none and most lines of a log two.
    """

    def replaced(text: str, patterns: list[tuple[str, str]]) -> str:
        for pattern, stand_in in patterns:
            text = substitute(text, UNICODE + pattern, stand_in)
        return text

    def step(text: str, possible: str, patterns: list[tuple[str, str]]) -> str:
        return f"CASE WHEN {possible} THEN {replaced(text, patterns)} ELSE {text} END"

    hexes, times, address, numbers = VOLATILE[:4], VOLATILE[4:6], VOLATILE[6:7], VOLATILE[7:]
    stable = let(
        step(line, search(line, "[0-9a-fA-F]{7}"), hexes),
        lambda a: let(
            step(a, f"contains({a}, ':')", times),
            lambda b: replaced(step(b, f"contains({b}, '0x') OR contains({b}, '0X')", address), numbers),
        ),
    )
    return strip(f"CASE WHEN {search(line, UNICODE + MAYBE_VOLATILE)} THEN {stable} ELSE {line} END")


def clip(line: str, width: int) -> str:
    """Cut a line to ``width`` characters. The marker adds up what earlier cuts dropped."""

    def cut(earlier: str) -> str:
        body = f"CASE WHEN {earlier} = '' THEN {line} ELSE {substitute(line, UNICODE + CLIPPED, '')} END"
        already = f"coalesce(try_cast({earlier} AS DECIMAL(30, 0)), 0)"
        return let(
            body,
            lambda b: f"CASE WHEN length({b}) <= {width} THEN {line} ELSE "
            f"concat(left({b}, {width}), '… ⟨+', string(length({b}) - {width} + {already}), ' chars⟩') END",
        )

    # A line no longer than the cap cannot have a body over it, so most lines stop at one length test.
    earlier = f"regexp_extract({line}, {lit(UNICODE + CLIPPED)}, 1)"
    return f"CASE WHEN length({line}) <= {width} THEN {line} ELSE {let(earlier, cut)} END"


def hit_file(line: str) -> str:
    """File of a ``path:line:`` search hit; NULL for any other line."""
    return f"nullif(regexp_extract({line}, {lit(UNICODE + HIT)}, 1), '')"


def snippet(text: str, width: int = 160) -> str:
    return f"left({strip(substitute(text, f'{UNICODE}{SPACE}+', ' '))}, {width})"


def slice_lines(lines: str, spec: str) -> str:
    """Lines ``a-b``, ``a-``, ``-b`` or ``n``, counted from 1; any other spec keeps all."""
    found = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", spec)
    if not found or not (found[1] or found[2]) or (not found[2] and found[3]):
        return lines
    first = max(1, int(found[1])) if found[1] else 1
    if found[2]:
        last = found[3] or f"size({lines})"
    else:
        last = found[1]
    return f"slice({lines}, {first}, greatest(0, {last} - {first} + 1))"
