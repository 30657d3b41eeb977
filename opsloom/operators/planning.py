"""Budgets, essential averages, emergency fund, goals and debt payoff."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.numbers import floor_quotient, pct, quotient, rounded_ratio
from opsloom.operators.summaries import month_bounds, month_of, period



def budget_status(ledger: DataFrame, budgets: DataFrame, month: str) -> DataFrame:
    """Per budget (budget_id, category_id, limit_cents): spent, left, used share, straight-line projection, status."""
    start, end = month_bounds(month)
    days = (end - start).days + 1
    last = ledger.agg(F.max("date")).scalar()
    through = F.coalesce(F.least(last, F.lit(end).cast("date")), F.lit(start).cast("date"))
    elapsed = F.greatest(F.lit(1), F.datediff(through, F.lit(start).cast("date")) + 1)
    spent = period(ledger, start, end).filter(F.col("direction") == "expense").groupBy("category_id").agg(
        (-F.sum("amount_cents")).alias("spent_cents"))
    out = budgets.join(spent, "category_id", "left").withColumn("spent_cents", F.coalesce("spent_cents", F.lit(0)))
    out = out.withColumn("projected_cents", F.when(elapsed < days, quotient(F.col("spent_cents") * days, elapsed.cast("long")))
                         .otherwise(F.col("spent_cents")))
    return out.select(
        "budget_id", "category_id", "limit_cents", "spent_cents", (F.col("limit_cents") - F.col("spent_cents")).alias("remaining_cents"),
        pct(F.col("spent_cents"), F.col("limit_cents")).alias("used_pct"), "projected_cents",
        F.when(F.col("spent_cents") > F.col("limit_cents"), "over").when(F.col("projected_cents") > F.col("limit_cents"), "at_risk")
        .otherwise("on_track").alias("status"), through.alias("data_through"))


def essential_average(ledger: DataFrame, cats: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """Mean essential and total spending of the last ``n`` complete months (floored); the latest month counts
    only when the data reaches within three days of its end. ``cats`` has id and essential."""
    keys = list(by)
    ess = cats.select(F.col("id").alias("category_id"), F.col("essential").alias("__e"))
    per = ledger.groupBy(*keys, month_of(F.col("date")).alias("month"), "category_id").agg(
        (-F.sum(F.when(F.col("direction") == "expense", F.col("amount_cents")).otherwise(F.lit(0)))).alias("cents"),
        F.max("date").alias("__to"))
    per = per.join(ess, "category_id", "left").groupBy(*keys, "month").agg(
        F.sum(F.when(F.col("__e"), F.col("cents")).otherwise(F.lit(0))).alias("essential"), F.sum("cents").alias("total"), F.max("__to").alias("__to"))
    newest = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(F.desc("month"))
    ranked = per.withColumn("__r", F.row_number().over(newest))
    complete = F.col("__to") >= F.date_sub(F.last_day("__to"), 3)
    kept = ranked.filter((F.col("__r") > 1) | complete).withColumn("__k", F.row_number().over(newest)).filter(F.col("__k") <= n)
    return kept.groupBy(*keys).agg(
        F.array_sort(F.collect_list("month")).alias("months_used"),
        floor_quotient(F.sum("essential"), F.count("*")).alias("essential_avg_cents"),
        floor_quotient(F.sum("total"), F.count("*")).alias("total_avg_cents"))


def emergency_coverage(average: DataFrame, goals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Targets of three and six months and how many months the emergency goal's balance covers."""
    fund = goals.filter(F.col("kind") == "emergency_fund").groupBy(*by).agg(F.min_by("current_cents", "goal_id").alias("current_cents"))
    both = average.join(fund, list(by), "left") if by else average.withColumn("current_cents", fund.select("current_cents").scalar())
    e = F.when(F.col("essential_avg_cents") != 0, F.col("essential_avg_cents"))
    return both.select(*by, "essential_avg_cents", (e * 3).alias("recommended_3mo_cents"), (e * 6).alias("recommended_6mo_cents"),
                       "current_cents", rounded_ratio(F.col("current_cents"), e, 1).alias("months_covered"))


def goal_progress(goals: DataFrame, today: Column) -> DataFrame:
    """goals: goal_id, kind, target_cents, current_cents, target_date."""
    left = F.greatest(F.col("target_cents") - F.col("current_cents"), F.lit(0))
    ahead = F.col("target_date") > today
    months = F.greatest(F.lit(1), (F.year("target_date") - F.year(today)) * 12 + F.month("target_date") - F.month(today))
    return goals.select(
        "goal_id", "kind", "target_cents", "current_cents", left.alias("remaining_cents"),
        pct(F.col("current_cents"), F.col("target_cents")).alias("progress_pct"), F.when(ahead, months).alias("months_left"),
        F.when(ahead, -floor_quotient(-left, months.cast("long"))).alias("required_monthly_cents"))
