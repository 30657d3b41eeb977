"""Integer arithmetic on cents, exact in every engine."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def cents(amount: Column) -> Column:
    """A decimal amount held as double, as signed integer cents (``rint`` stays in generated code)."""
    return F.rint(amount * 100).cast("long")


def quotient(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, b)


def floor_quotient(a: Column, b: Column) -> Column:
    """Integer division toward minus infinity; null for a zero divisor."""
    safe = F.when(b != 0, b)
    exact = (a - F.pmod(a, safe))
    return F.when(safe.isNotNull(), quotient(exact, safe))


def rounded_ratio(num: Column, den: Column, scale: int, digits: int = 1) -> Column:
    """``scale * num / den`` to ``digits`` places, ties to even, computed on integers.

    Null for a zero denominator.
    """
    n = (F.abs(num) * (scale * 10 ** digits)).cast(WIDE)
    d = F.abs(F.when(den != 0, den)).cast(WIDE)
    q = quotient(n, d)
    twice = (n - q.cast(WIDE) * d) * 2
    up = (twice > d) | ((twice == d) & (q % 2 == 1))
    sign = F.when((num < 0) != (den < 0), F.lit(-1)).otherwise(F.lit(1))
    return sign * (q + up.cast("long")) / F.lit(10.0 ** digits)


def pct(num: Column, den: Column) -> Column:
    return rounded_ratio(num, den, 100, 1)
