"""Ordered per-key computations that never put one key into one task.

A plain window partitioned by a hot key sorts all of that key's rows in a single task. Here every key is
cut into buckets that follow the order (a day, an hour): the window runs per (key, bucket), one small
summary row per (key, bucket) carries the value across bucket borders, and the two are joined back on
(key, bucket). The only window partitioned by the bare key sees one row per bucket.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


KEY = "__key"


def _keyed(df: DataFrame, keys: Sequence[str], bucket: str) -> DataFrame:
    """Add the key and bucket as one struct. Windows, sums and the join back all go by this one column, nulls
    included, so the rows are exchanged once and only the small summary moves again."""
    return df.withColumn(KEY, F.struct(*[F.col(c) for c in dict.fromkeys([*keys, bucket])]))


def _attach(df: DataFrame, carry: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.join(carry.select(KEY, *names), KEY, "left")


def _within(keys: Sequence[str], order: Sequence[str]):
    """Buckets of one key in order."""
    parts = [F.col(KEY)[k] for k in keys] or [F.lit(0)]
    return Window.partitionBy(*parts).orderBy(*[F.col(KEY)[c] for c in order])


def lag_over(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Add, per output name, the value of the previous row of the key (null on the first)."""
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    base = _keyed(df.withColumn("__v", packed), keys, bucket)
    local = base.withColumn("__lag_local", F.lag("__v").over(Window.partitionBy(KEY).orderBy(*order)))
    last = base.groupBy(KEY).agg(F.max_by("__v", F.struct(*order)).alias("__last"))
    carry = last.withColumn("__carry", F.lag("__last").over(_within(keys, [bucket]))).drop("__last")
    out = _attach(local, carry, ["__carry"])
    before = F.coalesce("__lag_local", "__carry")
    for n in values:
        out = out.withColumn(n, before[n])
    return out.drop("__v", "__lag_local", "__carry", KEY)


def running_sum(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Add the inclusive running sum of ``value`` in key order."""
    base = _keyed(df.withColumn("__x", value), keys, bucket)
    inside = Window.partitionBy(KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = base.withColumn("__run", F.sum("__x").over(inside))
    totals = base.groupBy(KEY).agg(F.sum("__x").alias("__tot"))
    across = _within(keys, [bucket]).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("__off", F.coalesce(F.sum("__tot").over(across), F.lit(0))).drop("__tot")
    out = _attach(local, carry, ["__off"])
    return out.withColumn(name, F.col("__off") + F.col("__run")).drop("__x", "__run", "__off", KEY)


def sessions_over(df: DataFrame, keys: Sequence[str], bucket: str, order: str, gap: int, name: str) -> DataFrame:
    """Number the sessions of each key: a new one starts when ``order`` jumps by more than ``gap``.

    One summary row per (key, bucket) holds the first and last value and how many sessions start inside.
    """
    inside = Window.partitionBy(KEY).orderBy(order)
    jump = F.coalesce((F.col(order) - F.lag(order).over(inside) > gap).cast("int"), F.lit(0))
    local = _keyed(df, keys, bucket).withColumn("__n", jump).withColumn("__run", F.sum("__n").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(KEY).agg(F.min(order).alias("__first"), F.max(order).alias("__last"), F.sum("__n").alias("__starts"))
    across = _within(keys, [bucket])
    before = F.lag("__last").over(across)
    opens = (before.isNull() | (F.col("__first") - before > gap)).cast("int")
    started = F.sum(F.col("__starts") + F.col("__opens")).over(across.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__starts")
    carry = ends.withColumn("__opens", opens).withColumn("__off", started)
    out = _attach(local, carry, ["__off"])
    return out.withColumn(name, F.col("__off") + F.col("__run")).drop("__n", "__run", "__off", KEY)


def recent_counts(df: DataFrame, keys: Sequence[str], second: str, span: int, name: str) -> DataFrame:
    """Add how many rows of the key fall in the ``span`` seconds before each row (same second included
    only through earlier seconds: the frame is ``[t - span, t)``).

    Rows are first counted per second, so a window partition holds at most ``2 * span`` rows however hot
    the key is: each second goes to its own block and, as history, to the next one. All history counts at the
    start of a block, and a second of it no longer ``span`` seconds after itself: running sums, no frame is read again for each second.
    """
    keyed = _keyed(df, keys, second)
    per_second = keyed.groupBy(KEY).agg(F.count("*").alias("__n"))
    block = F.floor(F.col(KEY)[second] / span)
    placed = per_second.withColumn("__block", F.explode(F.array(block, block + 1)))
    own = block == F.col("__block")
    history = Window.partitionBy(*[F.col(KEY)[k] for k in keys], "__block")
    before = history.orderBy(F.when(own, F.col(KEY)[second]).otherwise(F.col(KEY)[second] + span)).rangeBetween(Window.unboundedPreceding, -1)
    recent = F.coalesce(F.sum(F.when(~own, F.col("__n"))).over(history), F.lit(0)) + F.coalesce(F.sum(F.when(own, F.col("__n")).otherwise(-F.col("__n"))).over(before), F.lit(0))
    counted = placed.withColumn(name, recent).filter(own)
    return _attach(keyed, counted, [name]).drop(KEY)


def value_at_rank(df: DataFrame, column: str, rank: Column, grain: int, by: Sequence[str] = ()) -> DataFrame:
    """Exact element at a zero-based ``rank`` (a column over the row count ``n``) of a whole table or group.

    Two histogram passes: counts per ``grain``-wide range find the range that holds the rank, counts per
    value inside that one range find the element. No sort of the rows and no list of them anywhere.
    """
    keys = list(by)
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)))
    upto = w.orderBy("__r").rowsBetween(Window.unboundedPreceding, 0)
    ranged = df.select(*keys, F.col(column).alias("__v"), F.floor(F.col(column) / grain).alias("__r"))
    coarse = (
        ranged.groupBy(*keys, "__r").agg(F.count("*").alias("__c"))
        .withColumn("__hi", F.sum("__c").over(upto)).withColumn("n", F.sum("__c").over(w))
        .withColumn("__rank", rank)
        .filter((F.col("__rank") >= F.col("__hi") - F.col("__c")) & (F.col("__rank") < F.col("__hi")))
        .withColumn("__skip", F.col("__hi") - F.col("__c")).select(*keys, "__r", "n", "__rank", "__skip")
    )
    fine = ranged.join(coarse.select(*keys, "__r", "n", "__rank", "__skip"), [*keys, "__r"])
    fine = fine.groupBy(*keys, "n", "__rank", "__skip", "__v").agg(F.count("*").alias("__c"))
    steps = w.orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        fine.withColumn("__hi", F.col("__skip") + F.sum("__c").over(steps))
        .filter((F.col("__rank") >= F.col("__hi") - F.col("__c")) & (F.col("__rank") < F.col("__hi")))
        .select(*keys, "n", F.col("__v").alias("value"))
    )
