"""Registered ledger summary queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsloom.checks.registry import Registry, sql_floor_div, sql_ratio
from opsloom.checks.views import CATEGORIES, LEDGER, TRANSACTIONS, TREE
from opsloom.operators import categories as C
from opsloom.operators import summaries as Q
from opsloom.sources import tables as T

REG = Registry()
START, END = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
IN98 = "date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'"

FLOWS = """CAST(coalesce(sum(CASE WHEN direction='income' THEN amount_cents ELSE 0 END),0) AS BIGINT) AS income_cents,
 CAST(coalesce(-sum(CASE WHEN direction='expense' THEN amount_cents ELSE 0 END),0) AS BIGINT) AS spending_cents, count(*) AS txn_count"""
NET = f"income_cents-spending_cents AS net_cents, {sql_ratio('income_cents-spending_cents', 'income_cents')} AS savings_rate_pct"


@REG.query("ledger_search", f"""
WITH {TRANSACTIONS} SELECT id, date, amount_cents, merchant, status FROM v_txn
WHERE contains(lower(description),'brand#2 ') AND direction='expense' AND status='reviewed' AND NOT excluded
 AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND abs(amount_cents) BETWEEN 500000 AND 6000000""")
def ledger_search(spark, sf):
    return Q.search(T.transactions(spark, sf), text="Brand#2 ", direction="expense", status="reviewed", excluded=False,
                    date_from="1996-01-01", date_to="1997-12-31", min_cents=500000, max_cents=6000000).select(
        "id", "date", "amount_cents", "merchant", "status")


@REG.query("ledger_search_page", f"""
WITH {TRANSACTIONS} SELECT id, date, amount_cents FROM v_txn WHERE account_id='acct-7' AND direction='expense'
ORDER BY amount_cents, source_line, id LIMIT 25 OFFSET 50""")
def ledger_search_page(spark, sf):
    found = Q.search(T.transactions(spark, sf), account_id="acct-7", direction="expense")
    return Q.search_page(found, "amount_asc", page=3, page_size=25).select("id", "date", "amount_cents")


@REG.query("ledger_search_totals", f"""
WITH {TRANSACTIONS} SELECT count(*) AS total, CAST(coalesce(sum(amount_cents),0) AS BIGINT) AS sum_cents,
 count(*) FILTER (status='reviewed') AS reviewed FROM v_txn WHERE merchant='Brand#7'""")
def ledger_search_totals(spark, sf):
    return Q.search_totals(Q.search(T.transactions(spark, sf), merchant="Brand#7"))


@REG.query("ledger_summary", f"""
WITH {LEDGER}, s AS (SELECT {FLOWS}, count(*) FILTER (direction='transfer') AS transfers_excluded FROM v_ledger WHERE {IN98})
SELECT *, {NET} FROM s""")
def ledger_summary(spark, sf):
    return Q.summary(T.ledger(spark, sf), START, END)


@REG.query("ledger_summary_by_user", f"""
WITH {LEDGER}, s AS (SELECT user_id, {FLOWS}, count(*) FILTER (direction='transfer') AS transfers_excluded FROM v_ledger GROUP BY user_id)
SELECT *, {NET} FROM s""")
def ledger_summary_by_user(spark, sf):
    return Q.summary(T.ledger(spark, sf), by=["user_id"])


@REG.query("ledger_monthly", f"""
WITH {LEDGER}, s AS (SELECT strftime(date,'%Y-%m') AS month, {FLOWS}, true AS has_data FROM v_ledger GROUP BY 1) SELECT *, {NET} FROM s""")
def ledger_monthly(spark, sf):
    return Q.monthly(T.ledger(spark, sf))


@REG.query("ledger_monthly_spine", f"""
WITH {LEDGER}, s AS (SELECT strftime(date,'%Y-%m') AS month, {FLOWS}, true AS has_data FROM v_ledger GROUP BY 1),
m AS (SELECT strftime(d,'%Y-%m') AS month FROM range(DATE '2001-06-01', DATE '2002-06-01', INTERVAL 1 MONTH) t(d)),
j AS (SELECT m.month, coalesce(income_cents,0) AS income_cents, coalesce(spending_cents,0) AS spending_cents,
 coalesce(txn_count,0) AS txn_count, coalesce(has_data,false) AS has_data FROM m LEFT JOIN s USING (month))
SELECT *, {NET} FROM j""")
def ledger_monthly_spine(spark, sf):
    months = [f"2001-{m:02d}" for m in range(6, 13)] + [f"2002-{m:02d}" for m in range(1, 6)]
    return Q.monthly(T.ledger(spark, sf), months)


@REG.query("category_breakdown", f"""
WITH {LEDGER}, {CATEGORIES}, s AS (
 SELECT category_id, CAST(-sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS count FROM v_ledger
 WHERE {IN98} AND direction='expense' GROUP BY 1), t AS (SELECT *, CAST(sum(amount_cents) OVER () AS BIGINT) AS tot FROM s)
SELECT category_id, coalesce(path,'Uncategorized') AS category, coalesce(essential,false) AS essential, amount_cents, count,
 {sql_ratio('amount_cents', 'tot')} AS share_pct FROM t LEFT JOIN v_path ON id=category_id""")
def category_breakdown(spark, sf):
    return Q.category_breakdown(T.ledger(spark, sf), T.categories(spark, sf), START, END)


@REG.query("category_rollup", f"""
WITH {LEDGER}, {CATEGORIES}, s AS (
 SELECT coalesce(top_id, category_id) AS category_id, CAST(-sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS count
 FROM v_ledger LEFT JOIN v_path ON id=category_id WHERE {IN98} AND direction='expense' GROUP BY 1),
t AS (SELECT *, CAST(sum(amount_cents) OVER () AS BIGINT) AS tot FROM s)
SELECT category_id, coalesce(path,'Uncategorized') AS category, coalesce(essential,false) AS essential, amount_cents, count,
 {sql_ratio('amount_cents', 'tot')} AS share_pct FROM t LEFT JOIN v_path ON id=category_id""".replace("FROM v_ledger LEFT JOIN v_path ON id=category_id", "FROM v_ledger l LEFT JOIN v_path p ON p.id=l.category_id"))
def category_rollup(spark, sf):
    return Q.category_rollup(T.ledger(spark, sf), T.categories(spark, sf), START, END)


@REG.query("category_levels", f"""
WITH {LEDGER}, {CATEGORIES}, r AS (
 SELECT coalesce(t.name,'Uncategorized') AS top, coalesce(p.path,'Uncategorized') AS leaf, -amount_cents AS a
 FROM v_ledger l LEFT JOIN v_path p ON p.id=l.category_id LEFT JOIN v_cat t ON t.id=p.top_id WHERE direction='expense')
SELECT CASE WHEN grouping(top)=1 THEN 0 WHEN grouping(leaf)=1 THEN 1 ELSE 2 END AS level, top, leaf,
 CAST(sum(a) AS BIGINT) AS amount_cents FROM r GROUP BY ROLLUP(top, leaf)""")
def category_levels(spark, sf):
    return Q.category_levels(T.ledger(spark, sf), T.categories(spark, sf))


@REG.query("top_merchants", f"""
WITH {LEDGER}, {CATEGORIES}, s AS (
 SELECT merchant, CAST(-sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS count FROM v_ledger
 WHERE direction='expense' AND {IN98} GROUP BY 1), last AS (
 SELECT merchant, category_id FROM v_ledger WHERE direction='expense' AND {IN98}
 QUALIFY row_number() OVER (PARTITION BY merchant ORDER BY date DESC, id DESC)=1)
SELECT merchant, amount_cents, count, {sql_floor_div('amount_cents', 'count')} AS avg_cents, coalesce(path,'Uncategorized') AS category
FROM s JOIN last USING (merchant) LEFT JOIN v_path ON id=category_id ORDER BY amount_cents DESC, merchant LIMIT 10""")
def top_merchants(spark, sf):
    return Q.top_merchants(T.ledger(spark, sf), T.categories(spark, sf), START, END, 10)


@REG.query("top_merchants_by_user", f"""
WITH {LEDGER}, {CATEGORIES}, s AS (
 SELECT user_id, merchant, CAST(-sum(amount_cents) AS BIGINT) AS amount_cents, count(*) AS count FROM v_ledger
 WHERE direction='expense' GROUP BY 1,2), last AS (
 SELECT user_id, merchant, category_id FROM v_ledger WHERE direction='expense'
 QUALIFY row_number() OVER (PARTITION BY user_id, merchant ORDER BY date DESC, id DESC)=1),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY amount_cents DESC, merchant)<=3)
SELECT b.user_id, b.merchant, amount_cents, count, {sql_floor_div('amount_cents', 'count')} AS avg_cents, coalesce(path,'Uncategorized') AS category
FROM b JOIN last USING (user_id, merchant) LEFT JOIN v_path ON id=category_id""")
def top_merchants_by_user(spark, sf):
    return Q.top_merchants(T.ledger(spark, sf), T.categories(spark, sf), n=3, by=["user_id"])


@REG.query("compare_periods", f"""
WITH {LEDGER}, {CATEGORIES}, s AS (
 SELECT coalesce(path,'Uncategorized') AS category,
  CAST(-sum(CASE WHEN year(date)=1998 THEN amount_cents ELSE 0 END) AS BIGINT) AS current_cents,
  CAST(-sum(CASE WHEN year(date)=1997 THEN amount_cents ELSE 0 END) AS BIGINT) AS previous_cents
 FROM v_ledger l LEFT JOIN v_path p ON p.id=l.category_id WHERE direction='expense' AND year(date) IN (1997,1998) GROUP BY 1)
SELECT *, current_cents-previous_cents AS change_cents, {sql_ratio('current_cents-previous_cents', 'previous_cents')} AS change_pct FROM s""")
def compare_periods(spark, sf):
    return Q.compare_periods(T.ledger(spark, sf), T.categories(spark, sf), (START, END),
                             (dt.date(1997, 1, 1), dt.date(1997, 12, 31)))


@REG.query("year_over_year", f"""
WITH {LEDGER}, s AS (SELECT year(date) AS y, strftime(date,'%m') AS month, {FLOWS} FROM v_ledger GROUP BY 1,2),
m AS (SELECT lpad(CAST(i AS VARCHAR),2,'0') AS month FROM range(1,13) t(i))
SELECT m.month, coalesce(a.spending_cents,0) AS spending_cents, coalesce(b.spending_cents,0) AS prev_spending_cents,
 coalesce(a.income_cents,0) AS income_cents, coalesce(b.income_cents,0) AS prev_income_cents,
 a.month IS NOT NULL AS has_data, b.month IS NOT NULL AS prev_has_data
FROM m LEFT JOIN s a ON a.month=m.month AND a.y=2001 LEFT JOIN s b ON b.month=m.month AND b.y=2000""")
def year_over_year(spark, sf):
    return Q.year_over_year(T.ledger(spark, sf), 2001)


MONTH_COLUMNS = ", ".join(f"CAST(coalesce(sum(v) FILTER (m='{m:02d}'),0) AS BIGINT) AS m{m:02d}" for m in range(1, 13))


@REG.query("monthly_report", f"""
WITH {LEDGER}, {CATEGORIES}, r AS (
 SELECT 0 AS line, coalesce(path,'Uncategorized') AS category, strftime(date,'%m') AS m, -amount_cents AS v
 FROM v_ledger l LEFT JOIN v_path p ON p.id=l.category_id WHERE direction='expense' AND {IN98}
 UNION ALL SELECT 1,'TOTAL SPENDING',strftime(date,'%m'),-amount_cents FROM v_ledger WHERE direction='expense' AND {IN98}
 UNION ALL SELECT 2,'TOTAL INCOME',strftime(date,'%m'),amount_cents FROM v_ledger WHERE direction='income' AND {IN98}
 UNION ALL SELECT 3,'NET CASH FLOW',strftime(date,'%m'),amount_cents FROM v_ledger WHERE direction IN ('income','expense') AND {IN98})
SELECT line, category, {MONTH_COLUMNS}, CAST(sum(v) AS BIGINT) AS total FROM r GROUP BY 1,2""")
def monthly_report(spark, sf):
    return Q.monthly_report(T.ledger(spark, sf), T.categories(spark, sf), 1998)


@REG.query("ledger_quality", f"""
WITH {LEDGER}, s AS (SELECT count(*) AS txn_count, count(*) FILTER (status<>'reviewed') AS unreviewed,
 count(*) FILTER (category_id IS NULL) AS uncategorized FROM v_ledger) SELECT *, {sql_ratio('unreviewed', 'txn_count')} AS unreviewed_pct FROM s""")
def ledger_quality(spark, sf):
    return Q.quality(T.ledger(spark, sf))


@REG.query("ledger_data_range", f"""
WITH {LEDGER} SELECT min(date) AS from_date, max(date) AS to_date, string_agg(DISTINCT strftime(date,'%Y-%m'), ',' ORDER BY strftime(date,'%Y-%m')) AS months,
 strftime(max(date),'%Y-%m') AS latest_month FROM v_ledger""")
def ledger_data_range(spark, sf):
    return Q.data_range(T.ledger(spark, sf)).withColumn("months", F.array_join("months", ","))


@REG.query("ledger_export_rows", f"""
WITH {TRANSACTIONS}, u AS (SELECT *, CASE WHEN source_line%3=0 THEN '='||merchant WHEN source_line%3=1 THEN '-'||merchant ELSE merchant END AS m2 FROM v_txn)
SELECT id, strftime(date,'%Y-%m-%d') AS date, account_id AS account,
 CASE WHEN left(m2,1) IN ('=','+','-','@',chr(9),chr(13)) THEN ''''||m2 ELSE m2 END AS merchant, description, coalesce(category_id,'') AS category,
 direction, (CASE WHEN amount_cents<0 THEN '-' ELSE '' END)||CAST(abs(amount_cents)//100 AS VARCHAR)||'.'||lpad(CAST(abs(amount_cents)%100 AS VARCHAR),2,'0') AS amount,
 status, category_source, CASE WHEN excluded THEN 'yes' ELSE '' END AS excluded FROM u""")
def ledger_export_rows(spark, sf):
    txns = T.transactions(spark, sf)
    lead = F.when(F.col("source_line") % 3 == 0, "=").when(F.col("source_line") % 3 == 1, "-").otherwise("")
    return Q.export_rows(txns.withColumn("merchant", F.concat(lead, "merchant")))


@REG.query("ledger_bulk_review", f"""
WITH {TRANSACTIONS} SELECT status, count(*) AS n FROM (SELECT CASE WHEN abs(amount_cents)>5000000 THEN 'reviewed' ELSE status END AS status FROM v_txn) GROUP BY 1""")
def ledger_bulk_review(spark, sf):
    txns = T.transactions(spark, sf)
    ids = Q.search(txns, min_cents=5000001).select("id")
    return Q.bulk_review(txns, ids).groupBy("status").agg(F.count("*").alias("n"))


@REG.query("category_paths", f"""
WITH {TREE} SELECT c.id, c.name, c.parent_id, concat_ws(' › ', g.name, p.name, c.name) AS path, coalesce(g.id, p.id, c.id) AS top_id
FROM v_tree c LEFT JOIN v_tree p ON c.parent_id=p.id LEFT JOIN v_tree g ON p.parent_id=g.id""")
def category_paths(spark, sf):
    return C.category_paths(T.tree(spark, sf))
