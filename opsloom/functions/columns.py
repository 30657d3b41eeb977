"""Small helpers on columns."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body mentions it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def none_if_blank(text: Column) -> Column:
    """Blank text counts as missing."""
    return F.when(F.trim(text) != "", text)
