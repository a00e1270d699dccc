"""Glob patterns: ``*`` and ``?`` stay within a path segment, ``[a-z]`` and ``[^a]`` are classes, a backslash quotes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """An anchored regular expression that Java and Python read alike; ValueError for a malformed pattern."""
    out, i, n = "", 0, len(pattern)

    def literal(at: int) -> tuple[str, int]:
        if pattern[at] == "\\":
            at += 1
            if at == n:
                raise ValueError(f"bad pattern: {pattern}")
        c = pattern[at]
        return ("\\" + c if re.match(r"[^\w\s]", c, re.ASCII) and ord(c) < 128 else c), at + 1

    while i < n:
        c = pattern[i]
        if c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            i += 1
            negated = i < n and pattern[i] == "^"
            i += negated
            parts = ""
            while i < n and (pattern[i] != "]" or not parts):
                if pattern[i] in "-]":
                    raise ValueError(f"bad pattern: {pattern}")
                low, i = literal(i)
                if i + 1 < n and pattern[i] == "-":
                    if pattern[i + 1] == "]":
                        raise ValueError(f"bad pattern: {pattern}")
                    high, i = literal(i + 1)
                    parts += f"{low}-{high}"
                else:
                    parts += low
            if i >= n or not parts:
                raise ValueError(f"bad pattern: {pattern}")
            out, i = out + f"[{'^' if negated else ''}{parts}]", i + 1
        else:
            part, i = literal(i)
            out += part
    return f"^(?s:{out})$"  # Java's $ would also stand before a last line break


def matches_any(value: Column, patterns: list[str]) -> Column:
    """False without patterns."""
    found = F.lit(False)
    for p in patterns:
        found = found | value.rlike(glob_regex(p)[:-1] + r"\z")
    return found


def passes(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any include (all, if there is none) and no exclude."""
    return (matches_any(path, include) if include else F.lit(True)) & ~matches_any(path, exclude)
