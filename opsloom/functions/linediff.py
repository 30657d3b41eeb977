"""Differences of two texts line by line, in order, with lines of context: patience diff and its application."""
from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HUNKS = "array<struct<old_start: int, new_start: int, lines: array<string>>>"


def _anchors(old: list[str], new: list[str], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Longest rising chain of lines that stand exactly once in both ranges."""
    once_new = Counter(new[b0:b1])
    at = {new[j]: j for j in range(b0, b1) if once_new[new[j]] == 1}
    once_old = Counter(old[a0:a1])
    pairs = [(i, at[old[i]]) for i in range(a0, a1) if once_old[old[i]] == 1 and old[i] in at]
    ends: list[int] = []  # smallest last place in the new text of a chain of each length
    owner: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(ends, j)
        before[k] = owner[n - 1] if n else -1
        ends[n:n + 1], owner[n:n + 1] = [j], [k]
    chain, k = [], owner[-1] if owner else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    return chain[::-1]


def changed_runs(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(old from, old to, new from, new to) of what was replaced, in order.

    Equal heads and tails stay; lines that occur once on both sides part the rest; a part without such lines is replaced whole.
    """
    runs, todo = [], [(0, len(old), 0, len(new))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and old[a0] == new[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and old[a1 - 1] == new[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        chain = _anchors(old, new, a0, a1, b0, b1) if a0 < a1 and b0 < b1 else []
        if chain:
            starts = [(a0, b0)] + [(i + 1, j + 1) for i, j in chain]
            todo.extend((i, k, j, m) for (i, j), (k, m) in reversed(list(zip(starts, [*chain, (a1, b1)]))))
        elif a0 < a1 or b0 < b1:
            runs.append((a0, a1, b0, b1))
    return runs


def hunks_of(old: list[str], new: list[str], context: int) -> list[tuple[int, int, list[str]]]:
    """Hunks with first line numbers (from 1); lines begin with a blank, ``-`` or ``+``. Runs that share context are one hunk."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for run in changed_runs(old, new):
        if groups and run[0] - groups[-1][-1][1] <= 2 * context:
            groups[-1].append(run)
        else:
            groups.append([run])
    out = []
    for group in groups:
        at = max(group[0][0] - context, 0)
        first_old, first_new, lines = at + 1, group[0][2] - (group[0][0] - at) + 1, []
        for a0, a1, b0, b1 in group:
            lines += [" " + x for x in old[at:a0]] + ["-" + x for x in old[a0:a1]] + ["+" + x for x in new[b0:b1]]
            at = a1
        out.append((first_old, first_new, lines + [" " + x for x in old[at:at + context]]))
    return out


def line_hunks(old: Column, new: Column, context: int = 1) -> Column:
    """Hunks that lead from one text to the other; a null text has no lines, an empty one a single empty line."""
    @F.pandas_udf(HUNKS)
    def diff(a: pd.Series, b: pd.Series) -> pd.Series:
        cut = lambda text: [] if text is None else text.split("\n")
        return pd.Series([[{"old_start": i, "new_start": j, "lines": lines} for i, j, lines in hunks_of(cut(x), cut(y), context)] for x, y in zip(a, b)], dtype=object)
    return diff(old, new)


def apply_hunks(old: Column, hunks: Column) -> Column:
    """The new text from the old one and its hunks; null if no line is left. Spark functions only."""
    lines = F.coalesce(F.split(old, "\n"), F.array().cast("array<string>"))
    body = lambda h, signs: F.transform(F.filter(h["lines"], lambda x: F.substring(x, 1, 1).isin(*signs)), lambda x: F.substr(x, F.lit(2)))

    def step(state: Column, h: Column) -> Column:
        behind = h["old_start"] + F.size(body(h, (" ", "-")))
        kept = F.slice(lines, state["at"], h["old_start"] - state["at"])
        return F.struct(behind.alias("at"), F.concat(state["parts"], F.array(F.concat(kept, body(h, (" ", "+"))))).alias("parts"))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<array<string>>").alias("parts"))
    tail = lambda s: F.slice(lines, s["at"], F.greatest(F.size(lines) - s["at"] + 1, F.lit(0)))
    whole = F.aggregate(hunks, start, step, lambda s: F.concat(F.flatten(s["parts"]), tail(s)))
    return F.when(F.size(whole) > 0, F.array_join(whole, "\n"))
