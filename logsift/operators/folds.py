"""Folds over the lines of one output, as expressions on an array of lines.

Every fold is linear (or one sort) in the lines of its own row, so a corpus is folded in the scan
stage: no shuffle, and no key to be skewed on. ``Plain`` and ``Printed`` say what an array element is.
Most steps work on bare strings; folds that compare fingerprints work on ``struct<line, fp>``, so that a
fingerprint is taken once and again only for a line that changed.
"""

from __future__ import annotations

from collections.abc import Callable

from logsift.functions.text import fingerprint, fn, hit_file, let

Expr = Callable[[str], str]


class Plain:
    """Elements are the lines themselves."""

    @staticmethod
    def line(element: str) -> str:
        return element

    @staticmethod
    def make(line: str) -> str:
        return line


class Printed:
    """Elements carry their line and its fingerprint."""

    @staticmethod
    def line(element: str) -> str:
        return f"{element}.line"

    @staticmethod
    def make(line: str) -> str:
        return let(line, lambda l: f"named_struct('line', {l}, 'fp', {fingerprint(l)})")


Lines = type[Plain] | type[Printed]


def with_fingerprints(lines: str) -> str:
    return f"transform({lines}, {fn(lambda l: f"named_struct('line', {l}, 'fp', {fingerprint(l)})")})"


def without_fingerprints(items: str) -> str:
    return f"transform({items}, {fn(lambda x: f'{x}.line')})"


def at_least_one(items: str, kind: Lines) -> str:
    """An empty text is one empty line."""
    return let(items, lambda it: f"CASE WHEN size({it}) = 0 THEN array({kind.make("''")}) ELSE {it} END")


def keep_where(items: str, kind: Lines, wanted: Expr) -> str:
    return f"filter({items}, {fn(lambda x: wanted(kind.line(x)))})"


def rewrite_where(items: str, kind: Lines, touched: Expr, new: Expr) -> str:
    """Rewrite some lines; an output with none of them is passed on as it is."""
    one = fn(lambda x: f"CASE WHEN {touched(kind.line(x))} THEN {kind.make(new(kind.line(x)))} ELSE {x} END")
    some = fn(lambda x: touched(kind.line(x)))
    return f"CASE WHEN exists({items}, {some}) THEN transform({items}, {one}) ELSE {items} END"


def _run_starts(items: str, same: Expr) -> str:
    """Positions (from 0) at which ``same(position)`` does not continue the line before."""
    return f"filter(sequence(0, size({items}) - 1), {fn(lambda i: f'{i} = 0 OR NOT ({same(i)})')})"


def _runs(items: str, starts: str, body: Callable[[str, str], str]) -> str:
    """Concatenate ``body(start, length)`` over the runs."""

    def each(st: str) -> str:
        def run(s: str, k: str) -> str:
            return let(f"coalesce(get({st}, {k} + 1), size({items})) - {s}", lambda n: body(s, n))

        return f"flatten(transform({st}, {fn(run, 2)}))"

    return let(starts, each)


def _marker_fingerprint(count: str, before: str, after: str) -> str:
    """Fingerprint of a marker without running the patterns: only its count is volatile."""
    stand_in = f"CASE WHEN {count} >= 1000000 THEN '<hash>' ELSE '<n>' END"
    return f"concat('{before}', {stand_in}, '{after}')"


def collapse_repeats(items: str, threshold: int) -> str:
    """Neighbouring lines with one non-empty fingerprint: the first stays, a marker counts the run."""

    def fold(it: str) -> str:
        def run(s: str, n: str) -> str:
            marker = (
                f"named_struct('line', concat('    … ⟨×', string({n}), ' similar lines⟩'), "
                f"'fp', {_marker_fingerprint(n, '… ⟨×', ' similar lines⟩')})"
            )
            return f"CASE WHEN {n} >= {threshold} THEN array({it}[{s}], {marker}) ELSE slice({it}, {s} + 1, {n}) END"

        starts = _run_starts(it, lambda i: f"{it}[{i}].fp != '' AND {it}[{i}].fp = get({it}, {i} - 1).fp")
        return _runs(it, starts, run)

    return let(items, fold)


def _ranks(keys: str) -> str:
    """For each element its rank among, and the count of, equal keys.

    Sorting the row's own (key, position) pairs brings equal keys together, a second sort by position
    lines the ranks up with the elements again.
    """

    def ranked(srt: str) -> str:
        def run(s: str, n: str) -> str:
            one = fn(lambda x, j: f"named_struct('i', {x}.i, 'r', {j} + 1, 'c', {n})", 2)
            return f"transform(slice({srt}, {s} + 1, {n}), {one})"

        return f"sort_array({_runs(srt, _run_starts(srt, lambda i: f'{srt}[{i}].k <=> get({srt}, {i} - 1).k'), run)})"

    return let(f"sort_array(transform({keys}, {fn(lambda k, i: f"named_struct('k', {k}, 'i', {i})", 2)}))", ranked)


def _cap_groups(items: str, keys: str, keep: int, marker: Callable[[str, str], str]) -> str:
    """First ``keep`` elements per key stay, the next becomes ``marker(key, hidden)``, the rest go."""

    def fold(it: str, ks: str) -> str:
        def capped(ranks: str) -> str:
            def one(x: str, i: str) -> str:
                rank, count = f"{ranks}[{i}].r", f"{ranks}[{i}].c"
                return (
                    f"CASE WHEN {ks}[{i}] IS NULL OR {rank} <= {keep} THEN {x} "
                    f"WHEN {rank} = {keep + 1} THEN {marker(f'{ks}[{i}]', f'({count} - {keep})')} END"
                )

            return f"filter(transform({it}, {fn(one, 2)}), {fn(lambda x: f'{x} IS NOT NULL')})"

        return f"CASE WHEN size({it}) > {keep} THEN {let(_ranks(ks), capped)} ELSE {it} END"

    return let(items, lambda it: let(keys.format(items=it), lambda ks: fold(it, ks)))


def cascade_guard(items: str, most: int) -> str:
    """A fingerprint seen more than ``most`` times anywhere in the output keeps its first ``most``."""

    def marker(_: str, more: str) -> str:
        return (
            f"named_struct('line', concat('    … ⟨and ', string({more}), ' more like this⟩'), "
            f"'fp', {_marker_fingerprint(more, '… ⟨and ', ' more like this⟩')})"
        )

    return _cap_groups(items, f"transform({{items}}, {fn(lambda x: f"nullif({x}.fp, '')")})", most, marker)


def limit_per_file(items: str, keep: int, kind: Lines = Printed) -> str:
    """At most ``keep`` search hits per file; lines that are not hits always stay."""

    def marker(file: str, more: str) -> str:
        return kind.make(f"concat('    … ⟨+', string({more}), ' more in ', {file}, '⟩')")

    found = fn(lambda x: hit_file(kind.line(x))).replace("{", "{{").replace("}", "}}")
    return _cap_groups(items, f"transform({{items}}, {found})", keep, marker)


def keep_ends(items: str, head: int, tail: int, label: str = "lines", kind: Lines = Plain) -> str:
    """First ``head`` and last ``tail`` lines around a marker, when that is shorter."""
    head, tail = max(0, int(head)), max(0, int(tail))

    def cut(it: str) -> str:
        hidden = f"(size({it}) - {head + tail})"
        parts = [f"array({kind.make(f"concat('… ⟨', string({hidden}), ' {label} hidden⟩')")})"]
        if head:
            parts.insert(0, f"slice({it}, 1, {head})")
        if tail:
            parts.append(f"slice({it}, -{tail}, {tail})")
        return f"CASE WHEN {hidden} > 1 THEN concat({', '.join(parts)}) ELSE {it} END"

    return let(items, cut)


def squeeze_blanks(lines: str, is_blank: Expr) -> str:
    """Keep the first of neighbouring blank lines."""

    def squeezed(ls: str) -> str:
        follows = lambda i: f"coalesce({is_blank(f'get({ls}, {i} - 1)')}, false)"
        return f"filter({ls}, {fn(lambda l, i: f'NOT (({is_blank(l)}) AND {follows(i)})', 2)})"

    return let(lines, squeezed)
