"""Fast test whether any alternative of a pattern occurs in a text.

A long alternation is slow in a backtracking matcher, and most rules are plain words. Each top-level
alternative becomes a substring test; only an alternative with more than plain text is also run as a regular
expression, and only on texts that hold its longest plain part. The result equals ``rlike`` on the whole pattern.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def alternatives(pattern: str) -> list[str]:
    """Split at the ``|`` that stand outside groups and classes."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _skip(text: str, i: int) -> int:
    """Index after the group or class that opens at ``i``."""
    close, depth = (")", 0) if text[i] == "(" else ("]", 0)
    while i < len(text):
        if text[i] == "\\":
            i += 1
        elif text[i] in "([" and close == ")" and text[i] == "(":
            depth += 1
        elif text[i] == close:
            if close == "]" or depth == 1:
                return i + 1
            depth -= 1
        i += 1
    return i


def required_text(alternative: str) -> tuple[str, bool]:
    """Longest run of plain characters every match contains, and whether the run is the whole alternative."""
    runs, run, i, whole = [], "", 0, True
    while i < len(alternative):
        c = alternative[i]
        if c in "([":
            i, c, whole = _skip(alternative, i), None, False
        elif c == "\\":
            nxt = alternative[i + 1]
            c, i = (nxt, i + 2) if not nxt.isalnum() else (None, i + 2)
            whole = whole and c is not None
        elif c in ".^$":
            i, c, whole = i + 1, None, False
        else:
            i += 1
        quantified = i < len(alternative) and alternative[i] in "?*+{"
        if quantified:
            whole = False
            i = alternative.index("}", i) + 1 if alternative[i] == "{" else i + 1
            c = None
        if c is None:
            runs.append(run)
            run = ""
        else:
            run += c
    return max([*runs, run], key=len), whole


def occurs(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    """``text.rlike(pattern)``; with ``ignore_case`` the text must already be lower case."""
    tests = []
    for alt in alternatives(pattern):
        plain, whole = required_text(alt.lower() if ignore_case and "\\" not in alt else alt)
        if ignore_case:
            plain = plain.lower()
        if whole:
            tests.append(F.contains(text, F.lit(plain)))
        elif len(plain) >= 2:
            tests.append(F.contains(text, F.lit(plain)) & text.rlike(("(?i)" if ignore_case else "") + alt))
        else:
            tests.append(text.rlike(("(?i)" if ignore_case else "") + alt))
    return reduce(lambda a, b: a | b, tests)
