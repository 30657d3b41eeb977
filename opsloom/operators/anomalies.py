"""Unusual expenses: outliers against a merchant's history, large new merchants, repeated charges, category spikes.

Rows carry id, date, merchant, amount_cents, direction, account_id and category_id.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.operators.summaries import month_of
from opsloom.plans.hotkeys import lag_over, value_at_rank

LOOKBACK_DAYS = 90


def expenses(ledger: DataFrame) -> DataFrame:
    return ledger.filter((F.col("direction") == "expense") & (F.col("amount_cents") < 0)).withColumn("cents", -F.col("amount_cents"))


def lookback_start(ledger: DataFrame, days: int) -> Column:
    return F.date_sub(ledger.agg(F.max("date")).scalar(), days)


PRICE_BITS = 13


def price_range(cents: Column) -> Column:
    """Number of the price range of an amount: below 8192 each amount is its own, above that 4096 ranges per power of two."""
    def cut(v: Column) -> Column:
        shift = F.greatest(F.length(F.bin(v)) - PRICE_BITS, F.lit(0))
        return (shift * 2 ** (PRICE_BITS - 1) + F.call_function("shiftright", v, shift)).cast("int")
    return cut(cents.cast("long"))


def range_bounds(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest amount of price ranges."""
    half = 2 ** (PRICE_BITS - 1)
    shift = np.maximum(code // half - 1, 0)
    low = (code - shift * half) << shift
    return low, low + (1 << shift) - 1


def _near_middle(counts: np.ndarray) -> tuple[int, int, list[int], int, list[int]] | None:
    """History size, and for median and MAD how many elements lie before the ranges that hold it, and those ranges.

    The median lies in the ranges that hold its two ranks. With it only known to lie between two amounts, each range has a
    least and a greatest deviation; the rank's value over all least ones and that over all greatest ones enclose the MAD.
    Ranges wholly nearer are only counted, ranges wholly farther are left out.
    """
    code = np.flatnonzero(counts)
    n = counts[code]
    upto = np.cumsum(n)
    history = int(upto[-1]) - 1 if len(upto) else 0
    if history < 3:
        return None
    ranks = np.array([(history - 1) // 2, history // 2])
    at = np.searchsorted(upto, ranks, "right")
    low, high = range_bounds(code.astype(np.int64))
    first, last = low[at[0]], high[at[1]]  # the median lies between these
    least = np.maximum(np.maximum(low - last, first - high), 0)
    most = np.maximum(high - first, last - low)

    def ranked(values: np.ndarray, rank: int) -> int:
        order = np.argsort(values, kind="stable")
        return int(values[order[np.searchsorted(np.cumsum(n[order]), rank, "right")]])
    bottom, top = ranked(least, ranks[0]), ranked(most, ranks[1])
    inner = most < bottom
    open_ = ~inner & (least <= top)
    return history, int(upto[at[0]] - n[at[0]]), code[np.unique(at)].tolist(), int(n[inner].sum()), code[open_].tolist()


def _walk_counters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by merchant and day: counters of price ranges, and behind those of a day the mark that asks for it."""
    merchant, counts = None, np.zeros(0, np.int64)
    for batch in batches:
        out = []
        names, asked = batch["merchant"].to_numpy(), batch["asked"].to_numpy()
        codes, ns, days = batch["range"].to_numpy(), batch["n"].to_numpy(), batch["day"].to_numpy()
        edge = np.flatnonzero(asked | np.append(names[1:] != names[:-1], True)) + 1
        begin = 0
        for end in edge.tolist():
            if names[begin] != merchant:
                merchant, counts = names[begin], np.zeros(1024, np.int64)
            add = end - 1 if asked[end - 1] else end
            if add > begin:
                top = int(codes[begin:add].max())
                if top >= len(counts):
                    counts = np.concatenate([counts, np.zeros(top + 1024 - len(counts), np.int64)])
                np.add.at(counts, codes[begin:add], ns[begin:add])
            if asked[end - 1]:
                found = _near_middle(counts)
                if found:
                    out.append((merchant, int(days[end - 1]), *found))
            begin = end
        yield pd.DataFrame(out, columns=["merchant", "day_no", "history", "med_skip", "med_ranges", "mad_skip", "mad_ranges"])


def _middle(steps: DataFrame, keys: list[str], value: str, skip: str) -> DataFrame:
    """Mean of the two middle elements of ``history`` ones, from the counted values around them, ``skip`` of them being before."""
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.withColumn("__hi", F.col(skip) + F.sum("n").over(upto))
    low, high = F.floor((F.col("history") - 1) / 2), F.floor(F.col("history") / 2)
    inside = lambda r: (r >= F.col("__hi") - F.col("n")) & (r < F.col("__hi"))
    return run.groupBy(*keys).agg(
        ((F.max(F.when(inside(low), F.col(value))) + F.max(F.when(inside(high), F.col(value)))) / 2).alias("middle"))


def merchant_history(exp: DataFrame, start: Column) -> DataFrame:
    """Per merchant and lookback date with a candidate charge: count, median and MAD of the history.

    The history of a charge is every charge of the merchant up to that day except itself. A charge can only be
    an outlier when it lies above that median, and taking one element from above the middle leaves the same
    lower elements whichever it is; so one median and one MAD per (merchant, date), taken over all but one of
    the elements, serve every candidate of that day.

    Exact order statistics as of a day by a counter tree of two levels: counters of price ranges with day stamps are
    walked by merchant and day (at most 220,000 ranges, whatever the number of charges) and name the few ranges around
    the middle; only the amounts in those meet the day, each with its own day stamps (at most lookback + 2).
    """
    known = exp.filter(F.col("merchant").isNotNull())
    floor_of = known.groupBy("merchant").agg(F.min("cents").alias("__low"))
    # no history element lies below the merchant's smallest charge, so smaller candidates cannot qualify
    recent = known.filter(F.col("date") >= start).groupBy("merchant", "date").agg(F.max("cents").alias("__top"))
    days = recent.join(floor_of, "merchant").filter(
        (F.col("__top") > F.col("__low") * 1.5) & (F.col("__top") - F.col("__low") >= 2000)).select(
        "merchant", F.unix_date("date").alias("day"))
    stamp = F.when(F.col("date") < start, F.lit(-(2 ** 31))).otherwise(F.unix_date("date"))
    counts = known.groupBy("merchant", "cents", stamp.alias("day")).agg(F.count("*").alias("n")).withColumn("range", price_range(F.col("cents")))
    counters = counts.groupBy("merchant", "day", "range").agg(F.sum("n").alias("n")).withColumn("asked", F.lit(False))
    marks = days.withColumn("range", F.lit(0)).withColumn("n", F.lit(0).cast("long")).withColumn("asked", F.lit(True))
    walk = counters.unionByName(marks).repartition("merchant").sortWithinPartitions("merchant", "day", "asked")
    near = walk.mapInPandas(_walk_counters, "merchant string, day_no int, history long, med_skip long, med_ranges array<int>, mad_skip long, mad_ranges array<int>")

    amounts = counts.groupBy("merchant", "range", "cents").agg(F.collect_list(F.struct("day", "n")).alias("stamps"))
    parts = F.concat(*[F.transform(c, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("range"))) for kind, c in (("med", "med_ranges"), ("mad", "mad_ranges"))])  # noqa: B023
    probes = near.select("merchant", "day_no", "history", "med_skip", "mad_skip", F.inline(parts))
    until = F.aggregate(F.filter("stamps", lambda e: e["day"] <= F.col("day_no")), F.lit(0).cast("long"), lambda a, e: a + e["n"])
    met = probes.join(amounts, ["merchant", "range"]).withColumn("n", until).filter("n > 0").drop("stamps", "range")
    keys = ["merchant", "day_no"]
    med = _middle(met.filter("kind = 'med'"), keys, "cents", "med_skip").withColumnRenamed("middle", "median")
    off = met.filter("kind = 'mad'").join(med, keys).withColumn("dev", F.abs(F.col("cents") - F.col("median")))
    dev = off.groupBy(*keys, "history", "mad_skip", "median", "dev").agg(F.sum("n").alias("n"))
    size = dev.groupBy(*keys).agg(F.max("history").alias("history"), F.max("median").alias("median"))
    mad = _middle(dev, keys, "dev", "mad_skip").withColumnRenamed("middle", "mad")
    return size.join(mad, keys).select("merchant", F.date_from_unix_date("day_no").alias("day"), "history", "median", "mad")


def merchant_outliers(ledger: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """Charges above 4 MADs, half as much again as the usual amount, and 2000 cents over it."""
    exp = expenses(ledger)
    start = lookback_start(ledger, days)
    usual = merchant_history(exp, start).withColumnRenamed("day", "date")
    hit = exp.filter(F.col("date") >= start).join(usual, ["merchant", "date"])
    spread = F.when(F.col("mad") == 0, F.greatest(F.col("median") * 0.1, F.lit(100.0))).otherwise(F.col("mad"))
    return hit.filter((F.col("cents") > F.col("median") + spread * 4) & (F.col("cents") > F.col("median") * 1.5)
                      & (F.col("cents") - F.col("median") >= 2000)).select(
        "id", "date", "merchant", F.col("cents").alias("amount_cents"), F.col("median").cast("long").alias("usual_cents"),
        F.col("history").alias("history_count"))


def new_large_merchants(ledger: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """First charge of a merchant, at least 20000 cents and at least the element at rank int(n * 0.95) of all."""
    exp = expenses(ledger)
    start = lookback_start(ledger, days)
    p95 = value_at_rank(exp, "cents", F.floor(F.col("n") * F.lit(0.95)), 10_000).filter(F.col("n") >= 20).select("value").scalar()
    # a charge is without history when it is its merchant's only charge up to its own day
    first = exp.groupBy("merchant").agg(F.min("date").alias("date"))
    opening = exp.join(first, ["merchant", "date"]).groupBy("merchant", "date").agg(
        F.count("*").alias("__n"), F.min("id").alias("id"), F.min("cents").alias("amount_cents")).filter(F.col("__n") == 1)
    return opening.filter((F.col("date") >= start) & (F.col("amount_cents") >= F.greatest(p95, F.lit(20000)))).select(
        "id", "date", "merchant", "amount_cents", p95.alias("p95_cents"))


def duplicate_charges(ledger: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """A charge equal to the merchant's previous one of that amount, at most two days later, same account."""
    start = lookback_start(ledger, days)
    big = expenses(ledger).filter((F.col("date") >= start) & (F.col("cents") >= 2000)).select(
        "id", "date", "merchant", "cents", "account_id")
    seen = lag_over(big, ["merchant", "cents"], "date", ["date", "id"],
                    {"other_date": F.col("date"), "other_account": F.col("account_id")})
    return seen.filter((F.datediff("date", "other_date") <= 2) & (F.col("other_account") == F.col("account_id"))).select(
        "id", "date", "merchant", F.col("cents").alias("amount_cents"), "other_date")


def category_spikes(ledger: DataFrame) -> DataFrame:
    """Categories whose latest month is over 1.5 times the mean of the three months listed before it, by 5000 or more.

    The months are those present in the ledger; a category missing in a prior month counts as zero there.
    """
    spent = ledger.groupBy(month_of(F.col("date")).alias("month"), "category_id").agg(
        (-F.sum(F.when(F.col("direction") == "expense", F.col("amount_cents")))).alias("cents"))
    months = spent.select("month").distinct().withColumn(
        "__r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("month")))).filter(F.col("__r") <= 4)
    four = spent.join(months, "month")
    sums = four.groupBy("category_id").agg(
        F.sum(F.when(F.col("__r") == 1, F.col("cents"))).alias("cents"),
        F.coalesce(F.sum(F.when(F.col("__r") > 1, F.col("cents"))), F.lit(0)).alias("prior"))
    latest = months.filter("__r = 1").select("month").scalar()
    enough = months.agg(F.count("*")).scalar() == 4
    mean = F.col("prior") / 3
    return sums.filter(enough & (F.col("prior") > 0) & (F.col("cents") > mean * 1.5) & (F.col("cents") - mean >= 5000)).select(
        latest.alias("month"), F.coalesce("category_id", F.lit("Uncategorized")).alias("category"),
        F.col("cents").alias("amount_cents"), F.floor(mean).cast("long").alias("average_cents"))


def anomalies(ledger: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """All four in one table: type, date text, transaction id, merchant or category, amount and reference amount."""
    def shape(df, kind, reference, **cols):
        return df.select(
            F.lit(kind).alias("type"), cols.get("date", F.date_format("date", "yyyy-MM-dd")).alias("date"),
            cols.get("id", F.col("id")).alias("id"), cols.get("merchant", F.col("merchant")).alias("merchant"),
            cols.get("category", F.lit(None).cast("string")).alias("category"), "amount_cents", reference.cast("long").alias("reference_cents"))
    none = F.lit(None).cast("string")
    return (
        shape(merchant_outliers(ledger, days), "merchant_outlier", F.col("usual_cents"))
        .unionByName(shape(new_large_merchants(ledger, days), "new_large_merchant", F.col("p95_cents")))
        .unionByName(shape(duplicate_charges(ledger, days), "possible_duplicate_charge", F.col("amount_cents")))
        .unionByName(shape(category_spikes(ledger), "category_spike", F.col("average_cents"), date=F.col("month"),
                           id=none, merchant=none, category=F.col("category"))))
