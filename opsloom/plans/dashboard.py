"""The ledger dashboard from one scan.

All totals come from one small table, the ledger summed by (month, direction, category, merchant); only recurring
payments and anomalies go back to the charges.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.operators import anomalies as A
from opsloom.operators import recurring as R
from opsloom.operators.categories import category_paths
from opsloom.operators.planning import budget_status
from opsloom.operators.summaries import UNCATEGORIZED, month_of
from opsloom.session import cut_lineage


def monthly_cube(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy(month_of(F.col("date")).alias("month"), "direction", "category_id", "merchant").agg(
        F.sum("amount_cents").alias("cents"), F.count("*").alias("n"))


def _previous(month: str) -> str:
    y, m = int(month[:4]), int(month[5:7])
    return f"{y - (m == 1)}-{12 if m == 1 else m - 1:02d}"


def totals(cube: DataFrame, cats: DataFrame, month: str, merchants: int = 5) -> dict[str, DataFrame]:
    """Sections of (label, cents): current and previous flows, the last 12 months' net, categories, merchants."""
    income = F.sum(F.when(F.col("direction") == "income", F.col("cents")).otherwise(F.lit(0)))
    spending = -F.sum(F.when(F.col("direction") == "expense", F.col("cents")).otherwise(F.lit(0)))

    def flows(m: str) -> DataFrame:
        one = cube.filter(F.col("month") == m).agg(F.coalesce(income, F.lit(0)).alias("income"), F.coalesce(spending, F.lit(0)).alias("spending"))
        return one.select(F.explode(F.create_map(F.lit("income"), F.col("income"), F.lit("spending"), F.col("spending"))).alias("label", "cents"))

    now = cube.filter((F.col("month") == month) & (F.col("direction") == "expense"))
    paths = category_paths(cats).select(F.col("id").alias("category_id"), "path")
    by_category = now.groupBy("category_id").agg((-F.sum("cents")).alias("cents")).join(paths, "category_id", "left")
    year = cube.filter((F.col("month") <= month) & (F.col("month") > f"{int(month[:4]) - 1}{month[4:]}"))
    return {
        "current": flows(month), "previous": flows(_previous(month)),
        "months": year.groupBy(F.col("month").alias("label")).agg((income - spending).alias("cents")),
        "categories": by_category.select(F.coalesce("path", F.lit(UNCATEGORIZED)).alias("label"), "cents"),
        "merchants": now.groupBy(F.col("merchant").alias("label")).agg((-F.sum("cents")).alias("cents")).orderBy(F.desc("cents"), "label").limit(merchants),
    }


def lists(ledger: DataFrame, budgets: DataFrame, month: str) -> dict[str, DataFrame]:
    """What needs a look: unusual charges of the last days and the month's budgets."""
    return {"anomalies": A.anomalies(ledger), "budgets": budget_status(ledger, budgets, month)}


def dashboard(ledger: DataFrame, cats: DataFrame, budgets: DataFrame, month: str) -> dict[str, DataFrame]:
    """Every widget; the cube is written once, as five of them read it. ``cats`` has id, name, parent_id, group, essential."""
    out = totals(cut_lineage(monthly_cube(ledger)), cats, month)
    out["recurring"] = R.recurring(ledger, cats).filter("active")
    return out | lists(ledger, budgets, month)
