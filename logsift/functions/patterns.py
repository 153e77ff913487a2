"""Patterns that users write in Python's dialect, spelled for the engine that runs them."""

from __future__ import annotations

import re
import warnings
from functools import lru_cache
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException

_GROUP = re.compile(r"\(\?P<(\w+)>")
_BACK = re.compile(r"\(\?P=(\w+)\)")
_TIMES = re.compile(r"\{(\d*)(,?)(\d*)\}")
_ESCAPES = {r"\Z": r"\z", r"\v": r"\x0B"}


def group_name(name: str) -> str:
    return name.replace("_", "U95")


def _char_class(pattern: str, at: int) -> tuple[str, int]:
    """The class that begins at ``at`` and where it ends; brackets, ampersands and a leading ``]`` in it are plain characters."""
    out, k = "[", at + 1
    if pattern.startswith("^", k):
        out, k = out + "^", k + 1
    first = k
    while k < len(pattern) and (pattern[k] != "]" or k == first):
        if pattern[k] == "\\":
            escape = pattern[k : k + 2]
            out += {r"\b": r"\x08", r"\v": r"\x0B"}.get(escape, escape)
            k += 2
            continue
        out += "\\" + pattern[k] if pattern[k] in "[]&" else pattern[k]
        k += 1
    return out + "]", k + 1


def java_pattern(pattern: str) -> str:
    """Named groups, anchors, character classes and repetitions as Java spells what Python means by them."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            out += _ESCAPES.get(pattern[k : k + 2], pattern[k : k + 2])
            k += 2
        elif c == "[":
            held, k = _char_class(pattern, k)
            out += held
        elif c == "{":
            times = _TIMES.match(pattern, k)
            if times and (times[1] or times[2]):
                out += "{" + (times[1] or "0") + times[2] + times[3] + "}"
                k = times.end()
            else:
                out, k = out + r"\{", k + 1
        elif named := _GROUP.match(pattern, k):
            out, k = f"{out}(?<{group_name(named[1])}>", named.end()
        elif named := _BACK.match(pattern, k):
            out, k = f"{out}\\k<{group_name(named[1])}>", named.end()
        else:
            out, k = out + c, k + 1
    return out


@lru_cache(maxsize=4096)
def _runs(pattern: str) -> bool:
    try:
        SparkContext.getOrCreate()._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


def readable(pattern: Any) -> bool:
    """Can the pattern be read here and run there? One that only Python knows matches nothing, with a warning."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", FutureWarning)  # of nested sets: a bracket in a class is a plain one
            re.compile(pattern)
    except (re.error, TypeError):
        return False
    if not isinstance(pattern, str):
        return False
    if _runs(java_pattern(pattern)):
        return True
    warnings.warn(f"pattern left out, it has no counterpart in Java: {pattern}", stacklevel=2)
    return False
