"""Ledger queries: search, totals, months, categories, merchants, comparisons, reports.

Money is signed integer cents, negative is money out; transfers count in neither income nor spending and
refunds offset spending. ``by`` keeps ledgers apart (for example ``["user_id"]``).
"""
from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.numbers import floor_quotient, pct
from opsloom.operators.categories import category_paths

UNCATEGORIZED = "Uncategorized"


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def month_bounds(month: str) -> tuple[dt.date, dt.date]:
    y, m = int(month[:4]), int(month[5:7])
    return dt.date(y, m, 1), dt.date(y, m, calendar.monthrange(y, m)[1])


def period(df: DataFrame, start, end) -> DataFrame:
    """Rows dated inside the window; the filter stays on the raw column so it can be pushed down."""
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col("date") <= F.lit(end).cast("date"))
    return df


def _whole(by: Sequence[str]):
    return Window.partitionBy(*(by or [F.lit(0)]))


def search(txns: DataFrame, text: str | None = None, date_from=None, date_to=None, min_cents: int | None = None,
           max_cents: int | None = None, excluded: bool | None = None, **equal: str) -> DataFrame:
    """AND of all given filters. ``equal`` may name account_id, category_id, direction, status, category_source,
    merchant or import_id; the text is literal and matched in any case."""
    out = period(txns, date_from, date_to)
    for column, value in equal.items():
        if value:
            out = out.filter(F.col(column) == value)
    if excluded is not None:
        out = out.filter(F.col("excluded") == F.lit(excluded))
    if min_cents is not None:
        out = out.filter(F.abs("amount_cents") >= min_cents)
    if max_cents is not None:
        out = out.filter(F.abs("amount_cents") <= max_cents)
    if text:
        needle = F.lit(text.lower())
        fields = [c for c in ("description", "merchant", "notes") if c in txns.columns]
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        out = out.filter(hit)
    return out


SORTS = {
    "date_desc": lambda: [F.desc("date"), F.asc("source_line"), F.asc("id")],
    "date_asc": lambda: [F.asc("date"), F.asc("source_line"), F.asc("id")],
    "amount_desc": lambda: [F.desc("amount_cents"), F.asc("source_line"), F.asc("id")],
    "amount_asc": lambda: [F.asc("amount_cents"), F.asc("source_line"), F.asc("id")],
}


def search_page(found: DataFrame, sort: str = "date_desc", page: int = 1, page_size: int = 50) -> DataFrame:
    return found.orderBy(*SORTS[sort]()).offset((page - 1) * page_size).limit(page_size)


def search_totals(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("sum_cents"),
                     F.count_if(F.col("status") == "reviewed").alias("reviewed"))


def _flows() -> list[Column]:
    income = F.sum(F.when(F.col("direction") == "income", F.col("amount_cents")).otherwise(F.lit(0)))
    spending = -F.sum(F.when(F.col("direction") == "expense", F.col("amount_cents")).otherwise(F.lit(0)))
    return [F.coalesce(income, F.lit(0)).alias("income_cents"), F.coalesce(spending, F.lit(0)).alias("spending_cents"),
            F.count("*").alias("txn_count")]


def _net(df: DataFrame) -> DataFrame:
    net = F.col("income_cents") - F.col("spending_cents")
    return df.withColumn("net_cents", net).withColumn("savings_rate_pct", pct(F.col("net_cents"), F.col("income_cents")))


def summary(ledger: DataFrame, start=None, end=None, by: Sequence[str] = ()) -> DataFrame:
    rows = period(ledger, start, end)
    return _net(rows.groupBy(*by).agg(
        *_flows(), F.count_if(F.col("direction") == "transfer").alias("transfers_excluded")))


def _month_rows(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ledger.groupBy(*by, month_of(F.col("date")).alias("month")).agg(*_flows())


def monthly(ledger: DataFrame, months: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """One row per month; with ``months`` exactly those, the missing ones flagged ``has_data = false``."""
    if months:
        first, last = month_bounds(min(months))[0], month_bounds(max(months))[1]
        ledger = period(ledger, first, last)
    got = _month_rows(ledger, by).withColumn("has_data", F.lit(True))
    if months:
        spine = ledger.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))
        if by:
            spine = ledger.select(*by).distinct().select(
                *by, F.explode(F.array(*[F.lit(m) for m in months])).alias("month"))
        zero = F.lit(0).cast("long")
        got = spine.join(got, [*by, "month"], "left").select(
            *by, "month", *[F.coalesce(c, zero).alias(c) for c in ("income_cents", "spending_cents", "txn_count")],
            F.coalesce("has_data", F.lit(False)).alias("has_data"))
    return _net(got)


def _category_sums(ledger: DataFrame, start, end, kind: str, by: Sequence[str], *extra: Column) -> DataFrame:
    sign = -1 if kind == "expense" else 1
    return period(ledger, start, end).filter(F.col("direction") == kind).groupBy(*by, *extra, "category_id").agg(
        (sign * F.sum("amount_cents")).alias("amount_cents"), F.count("*").alias("count"))


def _named(sums: DataFrame, cats: DataFrame, rollup: bool, by: Sequence[str], *extra: str) -> DataFrame:
    """Attach the display path (of the top parent for a rollup) to per-category sums."""
    paths = category_paths(cats).select(
        F.col("id").alias("category_id"), F.col("path"), F.col("top_id"), F.col("essential"))
    if rollup:
        up = paths.select("category_id", "top_id")
        sums = (sums.join(up, "category_id", "left").groupBy(*by, *extra, F.coalesce("top_id", "category_id").alias("category_id"))
                .agg(F.sum("amount_cents").alias("amount_cents"), F.sum("count").alias("count")))
    return sums.join(paths, "category_id", "left").select(
        *by, *extra, "category_id", F.coalesce("path", F.lit(UNCATEGORIZED)).alias("category"),
        F.coalesce("essential", F.lit(False)).alias("essential"), "amount_cents", "count")


def category_breakdown(ledger: DataFrame, cats: DataFrame, start=None, end=None, kind: str = "expense",
                       rollup: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Amount, count and share per category; the share window sees one row per category."""
    rows = _named(_category_sums(ledger, start, end, kind, by), cats, rollup, by)
    return rows.withColumn("share_pct", pct(F.col("amount_cents"), F.sum("amount_cents").over(_whole(by))))


def category_rollup(ledger: DataFrame, cats: DataFrame, start=None, end=None, kind: str = "expense") -> DataFrame:
    return category_breakdown(ledger, cats, start, end, kind, rollup=True)


def category_levels(ledger: DataFrame, cats: DataFrame, start=None, end=None) -> DataFrame:
    """Grand total, top-level totals and leaves in one ``rollup``; ``level`` 0 is the grand total."""
    paths = category_paths(cats).select(F.col("id").alias("category_id"), "path", "top_id")
    tops = cats.select(F.col("id").alias("top_id"), F.col("name").alias("top"))
    rows = _category_sums(ledger, start, end, "expense", ()).join(paths, "category_id", "left").join(tops, "top_id", "left")
    rows = rows.select(F.coalesce("top", F.lit(UNCATEGORIZED)).alias("top"),
                       F.coalesce("path", F.lit(UNCATEGORIZED)).alias("leaf"), "amount_cents")
    return rows.rollup("top", "leaf").agg(
        F.sum("amount_cents").alias("amount_cents"), F.grouping_id().alias("gid")).select(
        F.when(F.col("gid") == 3, 0).when(F.col("gid") == 1, 1).otherwise(2).alias("level"), "top", "leaf", "amount_cents")


def top_merchants(ledger: DataFrame, cats: DataFrame, start=None, end=None, n: int = 15, by: Sequence[str] = ()) -> DataFrame:
    spent = period(ledger, start, end).filter(F.col("direction") == "expense").groupBy(*by, "merchant").agg(
        (-F.sum("amount_cents")).alias("amount_cents"), F.count("*").alias("count"),
        F.max_by("category_id", F.struct("date", "id")).alias("category_id"))
    if by:
        order = Window.partitionBy(*by).orderBy(F.desc("amount_cents"), "merchant")
        best = spent.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= n).drop("__n")
    else:
        best = spent.orderBy(F.desc("amount_cents"), "merchant").limit(n)
    paths = category_paths(cats).select(F.col("id").alias("category_id"), "path")
    return best.join(paths, "category_id", "left").select(
        *by, "merchant", "amount_cents", "count", floor_quotient(F.col("amount_cents"), F.col("count")).alias("avg_cents"),
        F.coalesce("path", F.lit(UNCATEGORIZED)).alias("category"))


def compare_periods(ledger: DataFrame, cats: DataFrame, current: tuple, previous: tuple) -> DataFrame:
    """Both windows in one conditional aggregation over the rows of either."""
    def inside(p):
        return (F.col("date") >= F.lit(p[0]).cast("date")) & (F.col("date") <= F.lit(p[1]).cast("date"))

    rows = ledger.filter((F.col("direction") == "expense") & (inside(current) | inside(previous)))
    sums = rows.groupBy("category_id").agg(
        (-F.sum(F.when(inside(current), F.col("amount_cents")).otherwise(F.lit(0)))).alias("current_cents"),
        (-F.sum(F.when(inside(previous), F.col("amount_cents")).otherwise(F.lit(0)))).alias("previous_cents"))
    paths = category_paths(cats).select(F.col("id").alias("category_id"), "path")
    named = sums.join(paths, "category_id", "left").groupBy(
        F.coalesce("path", F.lit(UNCATEGORIZED)).alias("category")).agg(
        F.sum("current_cents").alias("current_cents"), F.sum("previous_cents").alias("previous_cents"))
    change = F.col("current_cents") - F.col("previous_cents")
    return named.withColumn("change_cents", change).withColumn(
        "change_pct", pct(F.col("change_cents"), F.col("previous_cents"))).orderBy(
        F.desc(F.abs("change_cents")), "category")


def year_over_year(ledger: DataFrame, year: int) -> DataFrame:
    months = [f"{y}-{m:02d}" for y in (year - 1, year) for m in range(1, 13)]
    rows = monthly(ledger, months).withColumn("mm", F.substring("month", 6, 2))
    this = F.substring("month", 1, 4) == str(year)
    pick = lambda c, cond, name: F.max(F.when(cond, F.col(c))).alias(name)
    return rows.groupBy(F.col("mm").alias("month")).agg(
        pick("spending_cents", this, "spending_cents"), pick("spending_cents", ~this, "prev_spending_cents"),
        pick("income_cents", this, "income_cents"), pick("income_cents", ~this, "prev_income_cents"),
        pick("has_data", this, "has_data"), pick("has_data", ~this, "prev_has_data"))


def monthly_report(ledger: DataFrame, cats: DataFrame, year: int) -> DataFrame:
    """Category by month matrix with totals, then TOTAL SPENDING, TOTAL INCOME and NET CASH FLOW."""
    start, end = dt.date(year, 1, 1), dt.date(year, 12, 31)
    months = [f"{year}-{m:02d}" for m in range(1, 13)]
    sums = _category_sums(ledger, start, end, "expense", (), month_of(F.col("date")).alias("month"))
    named = _named(sums, cats, False, (), "month").select("category", "month", F.col("amount_cents").alias("value"), F.lit(0).alias("line"))
    lines = [("TOTAL SPENDING", F.col("spending_cents"), 1), ("TOTAL INCOME", F.col("income_cents"), 2),
             ("NET CASH FLOW", F.col("income_cents") - F.col("spending_cents"), 3)]
    flows = _month_rows(period(ledger, start, end)).select("month", F.explode(F.array(*[
        F.struct(F.lit(n).alias("category"), v.alias("value"), F.lit(i).alias("line")) for n, v, i in lines])).alias("f")).select("f.*", "month")
    wide = named.unionByName(flows).groupBy("line", "category").pivot("month", months).agg(F.sum("value"))
    filled = wide.select("line", "category", *[F.coalesce(F.col(f"`{m}`"), F.lit(0)).alias(f"m{m[5:]}") for m in months])
    total = sum((F.col(f"m{m[5:]}") for m in months[1:]), F.col("m01"))
    return filled.withColumn("total", total).orderBy("line", F.desc("total"), "category")


def quality(ledger: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    base = ledger.agg(
        F.count("*").alias("txn_count"), F.count_if(F.col("status") != "reviewed").alias("unreviewed"),
        F.count_if(F.col("category_id").isNull() | (F.col("category_id") == UNCATEGORIZED)).alias("uncategorized"))
    base = base.withColumn("unreviewed_pct", pct(F.col("unreviewed"), F.col("txn_count")))
    if imports is None:
        return base
    state = imports.agg(F.count_if(F.col("status") == "unbalanced").alias("imports_unbalanced"),
                        F.count_if(F.col("status") == "committed").alias("imports_without_balances"))
    return base.withColumn("__one", F.lit(1)).join(state.withColumn("__one", F.lit(1)), "__one").drop("__one")


def data_range(ledger: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First and last date, the months present in order, the latest month."""
    m = month_of(F.col("date"))
    return ledger.groupBy(*by).agg(
        F.min("date").alias("from_date"), F.max("date").alias("to_date"), F.collect_set(m).alias("__m")).select(
        *by, "from_date", "to_date", F.array_sort("__m").alias("months"), month_of(F.col("to_date")).alias("latest_month"))


def csv_safe(text: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a leading quote."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.substring(t, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), t)).otherwise(t)


def export_rows(txns: DataFrame) -> DataFrame:
    neg = F.when(F.col("amount_cents") < 0, "-").otherwise("")
    size = F.abs("amount_cents")
    amount = F.concat(neg, F.call_function("div", size, F.lit(100)).cast("string"), F.lit("."),
                      F.lpad((size % 100).cast("string"), 2, "0"))
    return txns.select(
        "id", F.date_format("date", "yyyy-MM-dd").alias("date"), csv_safe(F.col("account_id")).alias("account"),
        csv_safe(F.col("merchant")).alias("merchant"), csv_safe(F.col("description")).alias("description"),
        csv_safe(F.col("category_id")).alias("category"), "direction", amount.alias("amount"), "status",
        "category_source", F.when(F.col("excluded"), "yes").otherwise("").alias("excluded"))


def export_csv(txns: DataFrame, path: str) -> None:
    export_rows(txns).drop("id").write.mode("overwrite").option("header", True).csv(path)


def bulk_review(txns: DataFrame, ids: DataFrame, status: str = "reviewed") -> DataFrame:
    """Set the status of the listed ids; the join side is left to the optimizer's size check."""
    marked = ids.select(F.col("id")).distinct().withColumn("__hit", F.lit(True))
    return txns.join(marked, "id", "left").withColumn(
        "status", F.when(F.col("__hit"), F.lit(status)).otherwise(F.col("status"))).drop("__hit")
