"""Recurring payments: amount streams, gaps, cadence, kind, projection, near misses.

Input rows carry merchant, date, id, amount_cents, direction, category_id and optionally source_label; ``by``
keeps ledgers apart. Everything per merchant is first reduced to distinct dates, distinct amounts or the last
three charges, so the size of a group follows the calendar or the price list, never the number of charges.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.columns import let
from opsloom.functions.rules import BILL_GROUPS, ESSENTIAL_GROUPS, SUBSCRIPTION_HINT
from opsloom.session import cut_lineage

# fixed values: cadence, period in days, tolerance in days
CADENCES = [("weekly", 7.0, 2), ("biweekly", 14.0, 3), ("monthly", 30.4, 5), ("quarterly", 91.0, 10), ("annual", 365.0, 20)]
MIXED = "mixed in with other purchases from the same merchant"


# --- amount streams ------------------------------------------------------------------------------------------

def _breaks(cents: np.ndarray, counts: np.ndarray, seen: int) -> list[int]:
    """Where bands begin after the one that begins at 0, over ascending distinct prices; it is known to hold ``seen``.

    A price joins while within 20 % (or 200 cents) of the median of the band so far; a band that refuses one
    price refuses all larger ones. The medians before a whole stretch of candidates come from prefix sums at once.
    """
    upto = np.concatenate([[0], np.cumsum(counts)])
    starts, start, at, step = [], 0, max(seen, 1), 64
    while at < len(cents):
        end = min(at + step, len(cents))
        before = upto[at:end] - upto[start]
        low = np.searchsorted(upto, upto[start] + (before + 1) // 2) - 1
        high = np.searchsorted(upto, upto[start] + before // 2 + 1) - 1
        middle = (cents[low] + cents[high]) / 2
        refused = np.abs(cents[at:end] - middle) > np.maximum(200, middle * 0.20)
        if refused.any():
            start = at + int(refused.argmax())
            starts.append(start)
            at, step = start + 1, 64
        else:
            at, step = end, step * 2
    return starts


def _bands_of(keys: list[str]):
    """Batches sorted by keys and price -> the same rows with a band. From one batch to the next only the prices
    of the open band and their counts are carried."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, number = None, 0
        cents = counts = np.empty(0, "int64")
        for pdf in batches:
            firsts = pdf[keys].ne(pdf[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
            names = list(zip(*[pdf[k].iloc[firsts] for k in keys]))
            price, n, bands = pdf["cents"].to_numpy(), pdf["n"].to_numpy(), np.empty(len(pdf), "int32")
            for key, first, end in zip(names, firsts, [*firsts[1:], len(pdf)]):
                if key != current:
                    current, number, cents, counts = key, 0, cents[:0], counts[:0]
                seen = len(cents)
                cents, counts = np.concatenate([cents, price[first:end]]), np.concatenate([counts, n[first:end]])
                starts = _breaks(cents, counts, seen)
                bands[first:end] = number + np.searchsorted(starts, np.arange(seen, len(cents)), side="right")
                if starts:
                    number, cents, counts = number + len(starts), cents[starts[-1]:], counts[starts[-1]:]
            yield pdf[[*keys, "cents"]].assign(band=bands)
    return run


def _billing_plans(dates: Column) -> Column:
    """Ascending (date, day, n) -> (date, plan): the number of the date's billing day, 0 throughout unless the dates
    fall into at most four billing days of two or more charges each.

    A billing day is 31 running counts (charges up to each day of the month), which give its median; a date joins
    the first one whose median lies within four days. The array holds one stream's distinct dates: its length
    follows the calendar.
    """
    def middle(c):
        return (F.size(F.filter(c, lambda x: x * 2 < c[30])) + F.size(F.filter(c, lambda x: x * 2 <= c[30])) + 2) / 2

    def added(c, d):
        return F.transform(c, lambda x, i: x + F.when(i + 1 >= d["day"], d["n"]).otherwise(0))

    def step(acc, d):
        plans = acc["plans"]
        none = F.array_repeat(F.lit(0).cast("long"), 31)
        fits = F.array_position(F.transform(plans, lambda c: F.abs(middle(c) - d["day"]) <= 4), F.lit(True)).cast("int")
        after = let(fits, lambda hit: F.struct(
            F.when(hit == 0, F.concat(plans, F.array(added(none, d)))).otherwise(
                F.transform(plans, lambda c, i: F.when(i + 1 == hit, added(c, d)).otherwise(c))).alias("plans"),
            F.concat(acc["chosen"], F.array(F.when(hit == 0, F.size(plans)).otherwise(hit - 1))).alias("chosen")))
        return F.when(F.size(plans) > 4, acc).otherwise(after)

    empty = F.struct(F.expr("CAST(array() AS array<array<bigint>>)").alias("plans"), F.expr("CAST(array() AS array<int>)").alias("chosen"))
    return let(F.aggregate(dates, empty, step), lambda end: F.transform(dates, lambda d, i: F.struct(d["date"].alias("date"), F.when(
        (F.size(end["plans"]) <= 4) & F.forall(end["plans"], lambda c: c[30] >= 2), F.get(end["chosen"], i)).otherwise(0).alias("plan"))))


def amount_streams(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Add ``sign``, ``band`` (similar price) and ``plan`` (billing day within the price) to each charge.

    Bands are cut on distinct amounts per merchant, sorted by Spark and read as a stream, whole stretches at a time;
    billing days are found in one expression over the distinct dates of a band. The charges themselves only take
    part in equi-joins on (merchant, amount) and (merchant, band, date). The small assignment tables are
    checkpointed because several steps read them.
    """
    rows = ledger.filter((F.col("direction") != "transfer") & (F.col("amount_cents") != 0)).withColumn(
        "sign", F.signum("amount_cents").cast("int")).withColumn("cents", F.abs("amount_cents"))
    keys = [*by, "merchant", "sign"]
    types = dict(rows.dtypes)
    declared = ", ".join(f"`{k}` {types[k]}" for k in keys)
    prices = rows.groupBy(*keys, "cents").agg(F.count("*").alias("n"))
    banded = cut_lineage(prices.repartition(*keys).sortWithinPartitions(*keys, "cents").mapInPandas(
        _bands_of(keys), f"{declared}, cents bigint, band int"))
    rows = rows.join(banded, [*keys, "cents"])
    stream = [*keys, "band"]
    per_day = rows.groupBy(*stream, "date").agg(F.count("*").alias("n"))
    month = F.date_format("date", "yyyy-MM")
    crowded = per_day.groupBy(*stream).agg(F.sum("n").alias("__t"), F.countDistinct(month).alias("__m")).filter(
        (F.col("__t") >= 4) & (F.col("__m") < F.col("__t") * 0.75)).select(*stream)
    days = F.array_sort(F.collect_list(F.struct("date", F.dayofmonth("date").alias("day"), "n")))
    planned = cut_lineage(per_day.join(crowded, stream).groupBy(*stream).agg(days.alias("days")).select(
        *stream, F.explode(_billing_plans(F.col("days"))).alias("d")).select(*stream, "d.date", "d.plan").filter("plan > 0"))
    return rows.join(planned, [*stream, "date"], "left").withColumn("plan", F.coalesce("plan", F.lit(0)))


# --- gaps and cadence ----------------------------------------------------------------------------------------

def charge_gaps(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per stream: distinct dates, median / smallest / largest gap in days, share of regular gaps per cadence."""
    dates = rows.groupBy(*keys, "date").agg(F.count("*").alias("n"))
    gap = F.datediff("date", F.lag("date").over(Window.partitionBy(*keys).orderBy("date")))
    steps = dates.withColumn("gap", gap)
    shares = [F.avg((F.abs(F.col("gap") - p) <= t * 1.5).cast("double")).alias(f"share_{name}") for name, p, t in CADENCES]
    return steps.groupBy(*keys).agg(
        F.count("*").alias("occurrences"), F.sum("n").alias("n"), F.median("gap").alias("median_gap"),
        F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), *shares)


def classify_cadence(gaps: DataFrame) -> DataFrame:
    """Add ``cadence`` (first whose period fits the median gap), ``period``, ``tolerance`` and ``regular``."""
    def choose(value):
        out = F.when(F.lit(False), value(CADENCES[0]))
        for c in CADENCES:
            out = out.when(F.abs(F.col("median_gap") - c[1]) <= c[2], value(c))
        return out
    return gaps.withColumn("cadence", choose(lambda c: F.lit(c[0]))).withColumn("period", choose(lambda c: F.lit(c[1]))).withColumn(
        "tolerance", choose(lambda c: F.lit(c[2]))).withColumn("regular", choose(lambda c: F.col(f"share_{c[0]}"))).drop(
        *[f"share_{c[0]}" for c in CADENCES])


def _recent(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last three charges of each stream, newest first; the rank limit is applied before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("date"), F.desc("id"))
    label = F.col("source_label") if "source_label" in rows.columns else F.lit(None).cast("string")
    top = rows.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= 3)
    packed = F.struct("__r", F.abs("amount_cents").alias("cents"), "amount_cents", "date", "category_id", label.alias("source_label"))
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(packed)).alias("recent"))


def _ordinal(n: Column) -> Column:
    teen = (n % 100).between(10, 20)
    return F.concat(n.cast("string"), F.when(teen, "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))


def _money(cents: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number((F.abs(cents) / 100).cast("decimal(20,2)"), 2))


def classify_streams(rows: DataFrame, cats: DataFrame, keys: Sequence[str], data_end: Column) -> DataFrame:
    """One row per stream with kind, cadence, projection, ``ok`` and, where it fails, ``reason``.

    ``cats`` has id, name (display path), group (effective built-in) and essential. Streams that are neither
    recurring nor worth a reason have ``ok`` false and a null reason.
    """
    sign = F.col("sign")
    facts = classify_cadence(charge_gaps(rows, keys)).join(_recent(rows, keys), list(keys))
    named = cats.select(F.col("id").alias("category_id"), F.col("name").alias("__name"), F.col("group").alias("__group"),
                        F.col("essential").alias("__essential"))
    cents = F.transform("recent", lambda r: r["cents"])
    middle = F.when(F.size("recent") == 3, F.array_sort(cents)[1]).when(
        F.size("recent") == 2, F.floor((cents[0] + cents[1]) / 2)).otherwise(cents[0])
    s = facts.withColumn("category_id", F.col("recent")[0]["category_id"]).join(named, "category_id", "left")
    s = (s.withColumn("source_label", F.col("recent")[0]["source_label"]).withColumn("last_date", F.col("recent")[0]["date"])
         .withColumn("last_cents", F.col("recent")[0]["amount_cents"]).withColumn("typical", middle.cast("long"))
         .withColumn("__spread", F.array_max(cents) - F.array_min(cents))
         .withColumn("category", F.coalesce("__name", F.lit("Uncategorized"))))
    hint_rx = "(?i)" + SUBSCRIPTION_HINT
    s = s.withColumn("hint", F.col("category").rlike(hint_rx) | F.coalesce(F.col("source_label").rlike(hint_rx), F.lit(False)))
    s = s.withColumn("fixed", F.col("__spread") <= F.greatest(F.lit(100.0), F.col("typical") * 0.05))
    once = F.col("occurrences") == 1
    plain = F.col("fixed") | F.col("hint")
    enough = (F.col("occurrences") >= 3) | ((F.col("occurrences") == 2) & plain) | F.col("cadence").isin("quarterly", "annual")
    steady = enough & (F.col("regular") >= 0.6)
    one_each = F.col("occurrences") == F.col("n")
    group = F.coalesce("__group", F.lit(""))
    kind = (F.when(sign > 0, "income").when(group.isin(BILL_GROUPS), "bill").when(F.col("hint") & one_each, "subscription")
            .when(F.col("fixed") & one_each & ~F.coalesce("__essential", F.lit(False)) & ~group.isin(ESSENTIAL_GROUPS), "subscription")
            .when((F.col("__spread") / F.greatest(F.col("typical"), F.lit(1)) <= 0.15) & one_each, "recurring"))
    s = s.withColumn("kind", F.when(~once & F.col("cadence").isNotNull() & steady, kind))
    reason = (
        F.when(once, F.when((sign < 0) & F.col("hint"), "only one charge in the imported data"))
        .when(F.col("cadence").isNull(), F.when((F.col("occurrences") >= 3) & plain, F.concat(
            F.lit("charges are "), F.col("min_gap").cast("string"), F.lit("–"), F.col("max_gap").cast("string"),
            F.lit(" days apart, not a regular cadence"))))
        .when(~steady, F.when(plain, F.when(F.col("regular") < 0.6, "irregular timing").otherwise(
            F.concat(F.lit("only "), F.col("occurrences").cast("string"), F.lit(" charges and the amounts differ"))))))
    since = F.datediff(data_end, "last_date")
    active = since <= F.col("period") * 1.5 + F.col("tolerance")
    before = F.try_element_at("recent", F.lit(2))["cents"]
    change = F.when((F.col("kind") == "subscription") & (F.abs("last_cents") != before), F.abs("last_cents") - before).otherwise(F.lit(0))
    s = s.withColumn("ok", F.col("kind").isNotNull()).withColumn("reason", F.when(~F.col("ok"), reason))
    per = lambda days: (F.col("typical") * days / F.col("period")).cast("long") * sign
    return s.select(
        *keys, "n", "occurrences", "ok", "reason", "kind", "cadence",
        F.when(F.col("occurrences") == 2, "likely").otherwise("confirmed").alias("confidence"),
        (F.col("typical") * sign).alias("typical_cents"), "last_cents", "last_date", "category", "source_label", "hint",
        F.col("fixed").alias("fixed_amount"), active.alias("active"),
        F.when(active, F.date_add("last_date", F.bround("period").cast("int"))).alias("next_expected"),
        change.alias("price_change_cents"), per(30.4).alias("monthly_equivalent_cents"), per(365).alias("annual_cost_cents"),
        F.bround(F.col("regular") * 100).cast("long").alias("regularity_pct"),
        ((F.size("recent") == 3) & (F.col("__spread") <= F.greatest(F.lit(50), F.floor(F.abs("last_cents") / 100)))).alias("stable"))


def recurring_candidates(ledger: DataFrame, cats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Found payments (``found``) and near misses with their reason.

    A merchant whose charges form one regular payment is taken whole; only the others are split into streams,
    of which steady subscriptions are kept.
    """
    rows = ledger.filter((F.col("direction") != "transfer") & (F.col("amount_cents") != 0)).withColumn(
        "sign", F.signum("amount_cents").cast("int"))
    keys = [*by, "merchant", "sign"]
    end = ledger.groupBy(*by).agg(F.max("date").alias("__end"))
    if by:
        rows = rows.join(end, list(by))
        last = F.col("__end")
        whole_keys = [*keys, "__end"]
    else:
        last = end.select("__end").scalar()
        whole_keys = keys
    # one row per merchant, read by three branches: cut here so the ledger is scanned for it once
    whole = cut_lineage(classify_streams(rows, cats, whole_keys, last))
    taken = whole.filter(F.col("ok") & (F.col("occurrences") == F.col("n")))
    rest = rows.join(taken.select(*keys), keys, "left_anti")
    split = amount_streams(rest, by).select(*rows.columns, "band", "plan")
    stream_keys = [*whole_keys, "band", "plan"]
    price = split.groupBy(*stream_keys).agg(F.bround(F.median(F.abs("amount_cents"))).alias("__price"),
                                            F.bround(F.median(F.dayofmonth("date"))).cast("int").alias("__day"))
    same = Window.partitionBy(*keys, "__price")
    price = price.withColumn("__same", F.count("*").over(same)).withColumn("__streams", F.count("*").over(Window.partitionBy(*keys)))
    streams = classify_streams(split, cats, stream_keys, last).join(
        price.select(*keys, "band", "plan", "__same", "__day", "__streams"), [*keys, "band", "plan"])
    many = F.col("__streams") > 1
    good = (F.col("ok") & (F.col("kind") == "subscription") & F.col("stable")
            & F.col("cadence").isin("monthly", "quarterly", "annual") & (F.col("occurrences") == F.col("n")))
    label = F.when(F.col("__same") > 1, F.concat("merchant", F.lit(" (billed ~"), _ordinal(F.col("__day")), F.lit(")"))).otherwise(
        F.concat("merchant", F.lit(" ("), _money(F.col("typical_cents")), F.lit(")")))
    parts = streams.filter(many & (good | ((F.col("ok") | F.col("reason").isNotNull()) & F.col("hint")))).withColumn("found", good).withColumn(
        "label", F.when(F.col("occurrences") == 1, F.col("merchant")).otherwise(label))
    parts = parts.withColumn("reason", F.when(~F.col("found"), F.coalesce("reason", F.lit(MIXED))))
    single = price.filter(F.col("__streams") == 1).select(*keys)
    lone = whole.filter(~F.col("ok") & F.col("reason").isNotNull()).join(single, keys, "left_semi")
    columns = [*keys, "label", "found", "reason", "kind", "cadence", "confidence", "occurrences", "typical_cents", "last_cents",
               "last_date", "category", "active", "next_expected", "fixed_amount", "price_change_cents",
               "monthly_equivalent_cents", "annual_cost_cents", "regularity_pct"]
    first = taken.withColumn("found", F.lit(True)).withColumn("label", F.col("merchant"))
    third = lone.withColumn("found", F.lit(False)).withColumn("label", F.col("merchant"))
    out = first.select(*columns).unionByName(parts.select(*columns)).unionByName(third.select(*columns))
    return out.withColumn("kind", F.when(F.col("found"), F.col("kind")))


def recurring(ledger: DataFrame, cats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return recurring_candidates(ledger, cats, by).filter("found").drop("found", "reason")


def near_misses(ledger: DataFrame, cats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return recurring_candidates(ledger, cats, by).filter("NOT found").select(
        *by, "merchant", "label", "reason", "occurrences", "typical_cents", "last_date", "category", "cadence")
