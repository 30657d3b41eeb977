"""Registered queries on recurring payments, anomalies and planning."""
from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.checks.registry import Registry, sql_floor_div, sql_pick, sql_ratio
from opsloom.checks.views import CATEGORIES, CHARGES, LEDGER
from opsloom.functions.rules import BILL_GROUPS, ESSENTIAL_GROUPS, SUBSCRIPTION_HINT
from opsloom.operators import anomalies as A
from opsloom.operators import planning as P
from opsloom.operators import recurring as R
from opsloom.plans import dashboard as D
from opsloom.sources import tables as T

REG = Registry()

SUBS = f"""
v_sub AS (
 SELECT 'C'||CAST(k AS VARCHAR)||'-'||CAST(i AS VARCHAR) AS id, 'm'||CAST(k AS VARCHAR) AS merchant,
 CAST(CASE WHEN k%7=2 THEN start+to_months(CAST(i AS INTEGER)) WHEN k%7=6 THEN start+to_months(CAST(i//2 AS INTEGER))
  ELSE start+to_days(CAST(i*(CASE k%7 WHEN 0 THEN 7 WHEN 1 THEN 14 WHEN 3 THEN 91 WHEN 4 THEN 365 WHEN 5 THEN 9 ELSE 30 END)+CASE WHEN k%11=0 THEN i*i*3 ELSE 0 END AS INTEGER)) END AS DATE) AS date,
 CAST((CASE WHEN k%13=0 THEN 1 ELSE -1 END)*(CASE WHEN k%7=6 THEN CASE WHEN i%2=0 THEN base ELSE base*4 END WHEN k%5=0 THEN base+i*100 WHEN k%5=1 THEN base+(i%3)*(base//12) ELSE base END) AS BIGINT) AS amount_cents,
 CASE WHEN k%13=0 THEN 'income' ELSE 'expense' END AS direction, {sql_pick('k%6', T.PLANS)} AS category_id
 FROM (SELECT c_custkey AS k, unnest(range(0, 2+c_custkey%8)) AS i, 500+c_custkey%3000 AS base, DATE '2020-01-15'+CAST(c_custkey%40 AS INTEGER) AS start FROM customer))
"""
def dates(src: str, t: str = "") -> str:
    """Gaps and cadence per merchant of ``src``; ``t`` keeps the names of two uses apart."""
    return f"""
dts{t} AS (SELECT merchant, date, count(*) AS n FROM {src} GROUP BY 1,2),
gp{t} AS (SELECT *, date - lag(date) OVER (PARTITION BY merchant ORDER BY date) AS gap FROM dts{t}),
gs{t} AS (SELECT merchant, count(*) AS occurrences, CAST(sum(n) AS BIGINT) AS n, median(gap) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap,
 avg(CAST(abs(gap-7.0::DOUBLE)<=3.0 AS DOUBLE)) AS s1, avg(CAST(abs(gap-14.0::DOUBLE)<=4.5 AS DOUBLE)) AS s2, avg(CAST(abs(gap-30.4::DOUBLE)<=7.5 AS DOUBLE)) AS s3,
 avg(CAST(abs(gap-91.0::DOUBLE)<=15.0 AS DOUBLE)) AS s4, avg(CAST(abs(gap-365.0::DOUBLE)<=30.0 AS DOUBLE)) AS s5 FROM gp{t} GROUP BY 1),
cd{t} AS (SELECT *, CASE WHEN abs(median_gap-7)<=2 THEN 'weekly' WHEN abs(median_gap-14)<=3 THEN 'biweekly' WHEN abs(median_gap-30.4::DOUBLE)<=5 THEN 'monthly'
 WHEN abs(median_gap-91)<=10 THEN 'quarterly' WHEN abs(median_gap-365)<=20 THEN 'annual' END AS cadence FROM gs{t}),
cx{t} AS (SELECT *, CASE cadence WHEN 'weekly' THEN 7.0::DOUBLE WHEN 'biweekly' THEN 14.0 WHEN 'monthly' THEN 30.4::DOUBLE WHEN 'quarterly' THEN 91.0 WHEN 'annual' THEN 365.0 END AS period,
 CASE cadence WHEN 'weekly' THEN 2 WHEN 'biweekly' THEN 3 WHEN 'monthly' THEN 5 WHEN 'quarterly' THEN 10 WHEN 'annual' THEN 20 END AS tolerance,
 CASE cadence WHEN 'weekly' THEN s1 WHEN 'biweekly' THEN s2 WHEN 'monthly' THEN s3 WHEN 'quarterly' THEN s4 WHEN 'annual' THEN s5 END AS regular FROM cd{t})
"""


def signed(rows):
    return rows.withColumn("sign", F.signum("amount_cents").cast("int"))


@REG.query("charge_gaps", f"WITH {CHARGES}, {dates('v_charges')} SELECT merchant, occurrences, n, median_gap, min_gap, max_gap FROM gs")
def charge_gaps(spark, sf):
    return R.charge_gaps(T.charges(spark, sf), ["merchant"]).select("merchant", "occurrences", "n", "median_gap", "min_gap", "max_gap")


@REG.query("classify_cadence", f"""WITH {SUBS}, {dates('v_sub')}
SELECT merchant, cadence, period, tolerance, round(regular*1000000) AS regular_ppm FROM cx""")
def classify_cadence(spark, sf):
    return R.classify_cadence(R.charge_gaps(T.subscriptions(spark, sf), ["merchant"])).select(
        "merchant", "cadence", "period", "tolerance", F.round(F.col("regular") * 1000000).alias("regular_ppm"))


def in_list(values):
    return "(" + ",".join("'" + v + "'" for v in values) + ")"


def streams(src: str, t: str = "") -> str:
    """Facts and kind per merchant of ``src``, up to the last date of ``v_sub``."""
    return f"""{dates(src, t)},
rc{t} AS (SELECT merchant, list(abs(amount_cents) ORDER BY date DESC, id DESC)[1:3] AS c, first(amount_cents ORDER BY date DESC, id DESC) AS last_cents, max(date) AS last_date,
 first(category_id ORDER BY date DESC, id DESC) AS category FROM {src} GROUP BY 1),
f{t} AS (SELECT *, CASE WHEN last_cents>0 THEN 1 ELSE -1 END AS sign, list_max(c)-list_min(c) AS spread,
 CASE len(c) WHEN 3 THEN list_sort(c)[2] WHEN 2 THEN (c[1]+c[2])//2 ELSE c[1] END AS typical, (SELECT max(date) FROM v_sub) AS data_end,
 regexp_matches(category,'(?i){SUBSCRIPTION_HINT}') AS hint, CASE category WHEN 'Streaming' THEN 'Subscriptions' WHEN 'Gym' THEN 'Personal Care' ELSE category END AS grp,
 category IN ('Housing','Groceries','Utilities') AS essential FROM cx{t} JOIN rc{t} USING (merchant)),
g{t} AS (SELECT *, spread<=greatest(100.0::DOUBLE, typical*0.05::DOUBLE) AS fixed FROM f{t}),
h{t} AS (SELECT *, occurrences>1 AND cadence IS NOT NULL AND regular>=0.6::DOUBLE AND (occurrences>=3 OR (occurrences=2 AND (fixed OR hint)) OR cadence IN ('quarterly','annual')) AS steady FROM g{t}),
k{t} AS (SELECT *, CASE WHEN NOT steady THEN NULL WHEN sign>0 THEN 'income' WHEN grp IN {in_list(BILL_GROUPS)} THEN 'bill' WHEN hint AND occurrences=n THEN 'subscription'
 WHEN fixed AND occurrences=n AND NOT essential AND grp NOT IN {in_list(ESSENTIAL_GROUPS)} THEN 'subscription'
 WHEN spread::DOUBLE/greatest(typical,1)<=0.15::DOUBLE AND occurrences=n THEN 'recurring' END AS kind FROM h{t})
"""


# why a stream is no recurring payment, for streams that are worth a reason
REASON = """CASE WHEN kind IS NOT NULL THEN NULL WHEN occurrences=1 THEN CASE WHEN sign<0 AND hint THEN 'only one charge in the imported data' END
  WHEN cadence IS NULL THEN CASE WHEN occurrences>=3 AND (fixed OR hint) THEN 'charges are '||CAST(min_gap AS VARCHAR)||'–'||CAST(max_gap AS VARCHAR)||' days apart, not a regular cadence' END
  WHEN NOT steady AND (fixed OR hint) THEN CASE WHEN regular<0.6::DOUBLE THEN 'irregular timing' ELSE 'only '||CAST(occurrences AS VARCHAR)||' charges and the amounts differ' END END"""
STREAMS = f"WITH {SUBS}, {streams('v_sub')}"


def whole_streams(spark, sf):
    rows = signed(T.subscriptions(spark, sf))
    end = rows.agg(F.max("date")).scalar()
    return R.classify_streams(rows, T.plan_categories(spark), ["merchant", "sign"], end)


@REG.query("classify_kind", f"""{STREAMS}
SELECT merchant, kind, CASE WHEN occurrences=2 THEN 'likely' ELSE 'confirmed' END AS confidence, CAST(typical*sign AS BIGINT) AS typical_cents, fixed AS fixed_amount,
 {REASON} AS reason FROM k""")
def classify_kind(spark, sf):
    return whole_streams(spark, sf).select("merchant", "kind", "confidence", "typical_cents", "fixed_amount", "reason")


@REG.query("recurring_projection", f"""{STREAMS}, z AS (SELECT *, (data_end-last_date)<=period*1.5::DOUBLE+tolerance AS active FROM k WHERE kind IS NOT NULL)
SELECT merchant, active, CASE WHEN active THEN last_date+CAST(round_even(period,0) AS INTEGER) END AS next_expected,
 CAST(trunc(typical*30.4::DOUBLE/period) AS BIGINT)*sign AS monthly_equivalent_cents, CAST(trunc(typical*365.0::DOUBLE/period) AS BIGINT)*sign AS annual_cost_cents,
 CAST(CASE WHEN kind='subscription' AND abs(last_cents)<>c[2] THEN abs(last_cents)-c[2] ELSE 0 END AS BIGINT) AS price_change_cents FROM z""")
def recurring_projection(spark, sf):
    return whole_streams(spark, sf).filter("ok").select(
        "merchant", "active", "next_expected", "monthly_equivalent_cents", "annual_cost_cents", "price_change_cents")


def split(src: str) -> str:
    """``v_split``: the rows of ``src`` with price band and billing day. Every price is taken as the start of a band and its
    successor found from the medians up to each larger price; then the starts are walked, and the dates of crowded bands."""
    return f"""
mv AS (SELECT *, CAST(sign(amount_cents) AS INTEGER) AS sign, abs(amount_cents) AS cents FROM {src} WHERE direction<>'transfer' AND amount_cents<>0),
pc AS (SELECT merchant, sign, cents, row_number() OVER w AS r, CAST(sum(count(*)) OVER w AS BIGINT) AS upto, count(*) AS n
 FROM mv GROUP BY merchant, sign, cents WINDOW w AS (PARTITION BY merchant, sign ORDER BY cents)),
pos AS (SELECT merchant, sign, cents, row_number() OVER (PARTITION BY merchant, sign ORDER BY cents) AS p FROM mv),
trial AS (SELECT a.merchant, a.sign, a.r AS i, b.r AS j, b.cents, a.upto-a.n AS base, b.upto-b.n-a.upto+a.n AS held
 FROM pc a JOIN pc b ON a.merchant=b.merchant AND a.sign=b.sign AND b.r>a.r),
mid AS (SELECT t.merchant, t.sign, i, j, t.cents, (x.cents+y.cents)/2::DOUBLE AS med FROM trial t
 JOIN pos x ON x.merchant=t.merchant AND x.sign=t.sign AND x.p=base+(held+1)//2 JOIN pos y ON y.merchant=t.merchant AND y.sign=t.sign AND y.p=base+held//2+1),
follow AS (SELECT merchant, sign, i, min(j) AS j FROM mid WHERE abs(cents-med)>greatest(200.0::DOUBLE, med*0.2::DOUBLE) GROUP BY 1,2,3),
starts AS (SELECT merchant, sign, r, 0 AS band FROM pc WHERE r=1
 UNION ALL SELECT s.merchant, s.sign, f.j, s.band+1 FROM starts s JOIN follow f ON f.merchant=s.merchant AND f.sign=s.sign AND f.i=s.r),
banded AS (SELECT p.merchant, p.sign, p.cents, max(band) AS band FROM pc p JOIN starts s ON s.merchant=p.merchant AND s.sign=p.sign AND s.r<=p.r GROUP BY 1,2,3),
rb AS (SELECT mv.*, band FROM mv JOIN banded USING (merchant, sign, cents)),
crowd AS (SELECT merchant, sign, band FROM rb GROUP BY 1,2,3 HAVING count(*)>=4 AND count(DISTINCT strftime(date,'%Y-%m'))<count(*)*0.75::DOUBLE),
dd AS (SELECT merchant, sign, band, date, day(date) AS dom, list(day(date)) AS reps, row_number() OVER (PARTITION BY merchant, sign, band ORDER BY date) AS r
 FROM rb JOIN crowd USING (merchant, sign, band) GROUP BY merchant, sign, band, date),
pl AS (SELECT merchant, sign, band, date, r, [reps] AS plans, 0 AS plan FROM dd WHERE r=1
 UNION ALL SELECT merchant, sign, band, date, r, CASE WHEN hit=0 THEN list_append(plans, reps) ELSE list_concat(list_concat(plans[1:hit-1], [list_concat(plans[hit], reps)]), plans[hit+1:]) END,
  CASE WHEN hit=0 THEN len(plans) ELSE hit-1 END FROM (SELECT d.*, q.plans,
   CAST(coalesce(list_position(list_transform(q.plans, lambda z: abs(list_aggregate(z,'median')-d.dom)<=4), true),0) AS INTEGER) AS hit
   FROM pl q JOIN dd d ON d.merchant=q.merchant AND d.sign=q.sign AND d.band=q.band AND d.r=q.r+1 WHERE len(q.plans)<=4)),
fine AS (SELECT merchant, sign, band FROM (SELECT merchant, sign, band, max(r) AS last, arg_max(plans, r) AS plans FROM pl GROUP BY 1,2,3)
 JOIN (SELECT merchant, sign, band, count(*) AS last FROM dd GROUP BY 1,2,3) USING (merchant, sign, band, last)
 WHERE len(plans)<=4 AND list_min(list_transform(plans, lambda z: len(z)))>=2),
v_split AS (SELECT rb.*, coalesce(CASE WHEN fine.band IS NOT NULL THEN pl.plan END, 0) AS plan FROM rb LEFT JOIN pl USING (merchant, sign, band, date)
 LEFT JOIN fine ON fine.merchant=rb.merchant AND fine.sign=rb.sign AND fine.band=rb.band)"""


@REG.query("amount_streams", f"WITH RECURSIVE {CHARGES}, {split('v_charges')} SELECT id, merchant, amount_cents, band, plan FROM v_split")
def amount_streams(spark, sf):
    return R.amount_streams(T.charges(spark, sf)).select("id", "merchant", "amount_cents", "band", "plan")


def candidate(t: str) -> str:
    """Columns of a payment found in the facts of ``streams(..., t)``, with its reason and whether the last three are steady."""
    return f"""SELECT *, {REASON} AS reason, CAST(typical*sign AS BIGINT) AS typical_cents, CASE WHEN occurrences=2 THEN 'likely' ELSE 'confirmed' END AS confidence,
 (data_end-last_date)<=period*1.5::DOUBLE+tolerance AS active, CASE WHEN (data_end-last_date)<=period*1.5::DOUBLE+tolerance THEN last_date+CAST(round_even(period,0) AS INTEGER) END AS next_expected,
 CAST(CASE WHEN kind='subscription' AND abs(last_cents)<>c[2] THEN abs(last_cents)-c[2] ELSE 0 END AS BIGINT) AS price_change_cents,
 CAST(trunc(typical*30.4::DOUBLE/period) AS BIGINT)*sign AS monthly_equivalent_cents, CAST(trunc(typical*365.0::DOUBLE/period) AS BIGINT)*sign AS annual_cost_cents,
 CAST(round_even(regular*100,0) AS BIGINT) AS regularity_pct, len(c)=3 AND spread<=greatest(50, abs(last_cents)//100) AS stable FROM k{t}"""


FOUND = ("merchant, sign, label, found, reason, kind, cadence, confidence, occurrences, typical_cents, last_cents, last_date, category, active, next_expected, "
         "fixed AS fixed_amount, price_change_cents, monthly_equivalent_cents, annual_cost_cents, regularity_pct")
# fixed names of ordinals by SQL: 11th to 20th (and 10th) take "th"
NTH = "CAST(dom AS VARCHAR)||CASE WHEN dom%100 BETWEEN 10 AND 20 THEN 'th' WHEN dom%10=1 THEN 'st' WHEN dom%10=2 THEN 'nd' WHEN dom%10=3 THEN 'rd' ELSE 'th' END"
PAYMENTS = f"""WITH RECURSIVE {SUBS}, {streams('v_sub')},
whole AS ({candidate('')}),
taken AS (SELECT * FROM whole WHERE kind IS NOT NULL AND occurrences=n),
v_rest AS (SELECT * FROM v_sub WHERE merchant NOT IN (SELECT merchant FROM taken)), {split('v_rest')},
v_parts AS (SELECT merchant||'#'||CAST(band AS VARCHAR)||'#'||CAST(plan AS VARCHAR) AS merchant, merchant AS payee, id, date, amount_cents, category_id, cents FROM v_split),
{streams('v_parts', '2')},
price AS (SELECT *, count(*) OVER (PARTITION BY payee, price) AS same, count(*) OVER (PARTITION BY payee) AS many FROM
 (SELECT merchant, payee, round_even(median(cents),0) AS price, CAST(round_even(median(day(date)),0) AS INTEGER) AS dom FROM v_parts GROUP BY 1,2)),
piece AS (SELECT x.* REPLACE (payee AS merchant), payee, same, dom, coalesce(kind='subscription' AND stable AND cadence IN ('monthly','quarterly','annual') AND occurrences=n, false) AS found
 FROM ({candidate('2')}) x JOIN price USING (merchant) WHERE many>1),
every AS (
 SELECT {FOUND} FROM (SELECT *, true AS found, merchant AS label FROM taken)
 UNION ALL SELECT {FOUND} FROM (SELECT * REPLACE (CASE WHEN NOT found THEN coalesce(reason,'{R.MIXED}') END AS reason),
  CASE WHEN occurrences=1 THEN merchant WHEN same>1 THEN merchant||' (billed ~'||{NTH}||')' ELSE merchant||' ($'||format('{{:,.2f}}', typical/100.0)||')' END AS label
  FROM piece WHERE found OR ((kind IS NOT NULL OR reason IS NOT NULL) AND hint))
 UNION ALL SELECT {FOUND} FROM (SELECT *, false AS found, merchant AS label FROM whole WHERE kind IS NULL AND reason IS NOT NULL AND merchant IN (SELECT payee FROM price WHERE many=1)))
"""


@REG.query("recurring_payments", PAYMENTS + "SELECT * EXCLUDE (found, reason) FROM every WHERE found")
def recurring_payments(spark, sf):
    return R.recurring(T.subscriptions(spark, sf), T.plan_categories(spark))


@REG.query("recurring_near_misses", PAYMENTS + "SELECT merchant, label, reason, occurrences, typical_cents, last_date, category, cadence FROM every WHERE NOT found")
def recurring_near_misses(spark, sf):
    return R.near_misses(T.subscriptions(spark, sf), T.plan_categories(spark))


def exp(ctes: str, view: str, days: int) -> str:
    return f"""WITH {ctes}, ex AS (SELECT *, -amount_cents AS cents FROM {view} WHERE direction='expense' AND amount_cents<0), st AS (SELECT max(date)-{days} AS start FROM {view})"""


def outliers(ctes: str, view: str, days: int) -> str:
    return exp(ctes, view, days) + """,
p AS (SELECT t.id, t.date, t.merchant, t.cents, h.cents AS hc FROM ex t JOIN ex h ON h.merchant=t.merchant AND h.id<>t.id AND h.date<=t.date WHERE t.date>=(SELECT start FROM st)),
m AS (SELECT id, any_value(date) AS date, any_value(merchant) AS merchant, any_value(cents) AS cents, median(hc) AS med, count(*) AS n FROM p GROUP BY id HAVING count(*)>=3),
d AS (SELECT m.id, median(abs(hc-med)) AS mad FROM m JOIN p USING (id) GROUP BY m.id),
x AS (SELECT m.*, CASE WHEN mad=0 THEN greatest(med*0.1::DOUBLE,100.0) ELSE mad END AS sp FROM m JOIN d USING (id)),
o AS (SELECT id, date, merchant, cents AS amount_cents, CAST(trunc(med) AS BIGINT) AS usual_cents, n AS history_count FROM x WHERE cents>med+4*sp AND cents>med*1.5::DOUBLE AND cents-med>=2000)"""


def all_anomalies(ctes: str, view: str, days: int) -> str:
    """CTE ``an`` with the four kinds in one table."""
    return outliers(ctes, view, days) + f""",
q AS (SELECT cents AS p95 FROM (SELECT cents, row_number() OVER (ORDER BY cents)-1 AS r, count(*) OVER () AS n FROM ex) WHERE r=CAST(floor(n*0.95::DOUBLE) AS BIGINT) AND n>=20),
l AS (SELECT *, lag(date) OVER w AS other_date, lag(account_id) OVER w AS oa FROM ex WHERE date>=(SELECT start FROM st) AND cents>=2000 WINDOW w AS (PARTITION BY merchant, cents ORDER BY date, id)),
mm AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS rn FROM (SELECT DISTINCT strftime(date,'%Y-%m') AS month FROM {view})),
s AS (SELECT coalesce(category_id,'Uncategorized') AS category, CAST(-sum(amount_cents) FILTER (rn=1) AS BIGINT) AS cents, CAST(coalesce(-sum(amount_cents) FILTER (rn BETWEEN 2 AND 4),0) AS BIGINT) AS prior
 FROM {view} JOIN mm ON month=strftime(date,'%Y-%m') WHERE direction='expense' GROUP BY 1),
an AS (SELECT 'merchant_outlier' AS type, strftime(date,'%Y-%m-%d') AS date, id, merchant, NULL AS category, amount_cents, usual_cents AS reference_cents FROM o
UNION ALL SELECT 'new_large_merchant', strftime(t.date,'%Y-%m-%d'), t.id, t.merchant, NULL, t.cents, p95 FROM ex t, q WHERE t.date>=(SELECT start FROM st)
 AND NOT EXISTS (SELECT 1 FROM ex h WHERE h.merchant=t.merchant AND h.id<>t.id AND h.date<=t.date) AND t.cents>=greatest(p95,20000)
UNION ALL SELECT 'possible_duplicate_charge', strftime(date,'%Y-%m-%d'), id, merchant, NULL, cents, cents FROM l WHERE date-other_date<=2 AND oa=account_id
UNION ALL SELECT 'category_spike', (SELECT month FROM mm WHERE rn=1), NULL, NULL, category, cents, CAST(floor(prior::DOUBLE/3) AS BIGINT) FROM s
 WHERE (SELECT count(*) FROM mm WHERE rn<=4)=4 AND prior>0 AND cents>prior::DOUBLE/3*1.5::DOUBLE AND cents-prior::DOUBLE/3>=5000)"""


@REG.query("merchant_outliers", outliers(CHARGES, "v_charges", 20) + " SELECT * FROM o")
def merchant_outliers(spark, sf):
    return A.merchant_outliers(T.charges(spark, sf), 20)


SUB_EXP = f"""WITH {SUBS}, ex AS (SELECT *, -amount_cents AS cents FROM v_sub WHERE direction='expense'), st AS (SELECT max(date)-{{days}} AS start FROM v_sub)"""


def larger_openings(spark, sf):
    """The subscription series with some merchants' prices times 400, so that their first charges are large."""
    large = F.substring("merchant", -2, 2).isin("00", "50")
    return T.subscriptions(spark, sf).withColumn("amount_cents", F.when(large, F.col("amount_cents") * 400).otherwise(F.col("amount_cents")))


@REG.query("new_large_merchants", SUB_EXP.format(days=20000) + """,
e2 AS (SELECT * REPLACE (CASE WHEN right(merchant,2) IN ('00','50') THEN cents*400 ELSE cents END AS cents) FROM ex),
p AS (SELECT cents AS p95 FROM (SELECT cents, row_number() OVER (ORDER BY cents)-1 AS r, count(*) OVER () AS n FROM e2) WHERE r=CAST(floor(n*0.95::DOUBLE) AS BIGINT) AND n>=20)
SELECT t.id, t.date, t.merchant, t.cents AS amount_cents, p95 AS p95_cents FROM e2 t, p WHERE t.date>=(SELECT start FROM st)
 AND NOT EXISTS (SELECT 1 FROM e2 h WHERE h.merchant=t.merchant AND h.id<>t.id AND h.date<=t.date) AND t.cents>=greatest(p95,20000)""")
def new_large_merchants(spark, sf):
    return A.new_large_merchants(larger_openings(spark, sf), 20000)


@REG.query("duplicate_charges", f"""WITH {LEDGER}, r AS (SELECT id, date, merchant, -amount_cents//1000000 AS amount_cents, account_id FROM v_ledger WHERE direction='expense' AND amount_cents<0 AND date>=(SELECT max(date)-400 FROM v_ledger)),
l AS (SELECT *, lag(date) OVER w AS other_date, lag(account_id) OVER w AS oa FROM r WHERE amount_cents*2000>=2000 WINDOW w AS (PARTITION BY merchant, amount_cents ORDER BY date, id))
SELECT id, date, merchant, amount_cents*2000 AS amount_cents, other_date FROM l WHERE date-other_date<=2 AND oa=account_id""")
def duplicate_charges(spark, sf):
    rows = T.ledger(spark, sf)
    coarse = F.when(F.col("amount_cents") < 0, -F.floor(-F.col("amount_cents") / 1000000) * 2000).otherwise(F.col("amount_cents"))
    return A.duplicate_charges(rows.withColumn("amount_cents", coarse), 400)


@REG.query("category_spikes", f"""WITH {LEDGER}, r AS (SELECT *, CASE WHEN category_id='PROMO' AND strftime(date,'%Y-%m')=(SELECT strftime(max(date),'%Y-%m') FROM v_ledger) THEN amount_cents*90 ELSE amount_cents END AS c FROM v_ledger),
mm AS (SELECT month, row_number() OVER (ORDER BY month DESC) AS rn FROM (SELECT DISTINCT strftime(date,'%Y-%m') AS month FROM v_ledger)),
s AS (SELECT coalesce(category_id,'Uncategorized') AS category, CAST(-sum(c) FILTER (rn=1) AS BIGINT) AS cents, CAST(coalesce(-sum(c) FILTER (rn BETWEEN 2 AND 4),0) AS BIGINT) AS prior
 FROM r JOIN mm ON month=strftime(date,'%Y-%m') WHERE direction='expense' GROUP BY 1)
SELECT (SELECT month FROM mm WHERE rn=1) AS month, category, cents AS amount_cents, CAST(floor(prior::DOUBLE/3) AS BIGINT) AS average_cents FROM s
WHERE (SELECT count(*) FROM mm WHERE rn<=4)=4 AND prior>0 AND cents>prior::DOUBLE/3*1.5::DOUBLE AND cents-prior::DOUBLE/3>=5000""")
def category_spikes(spark, sf):
    rows = T.ledger(spark, sf)
    last = rows.agg(F.max("date")).scalar()
    grown = (F.col("category_id") == "PROMO") & (F.date_format("date", "yyyy-MM") == F.date_format(last, "yyyy-MM"))
    return A.category_spikes(rows.withColumn("amount_cents", F.when(grown, F.col("amount_cents") * 90).otherwise(F.col("amount_cents"))))


@REG.query("anomalies", all_anomalies(CHARGES, "v_charges", 20) + " SELECT * FROM an")
def anomalies(spark, sf):
    return A.anomalies(T.charges(spark, sf), 20)


def budgets(spark, sf):
    return T.categories(spark, sf).filter("kind = 'expense' AND parent_id IS NOT NULL").select(
        F.concat(F.lit("b-"), "id").alias("budget_id"), F.col("id").alias("category_id"),
        (F.length("id") * 100000000).cast("long").alias("limit_cents"))


BUDGETS = f"""b AS (SELECT 'b-'||id AS budget_id, id AS category_id, CAST(length(id)*100000000 AS BIGINT) AS limit_cents FROM v_cat WHERE kind='expense' AND parent_id IS NOT NULL),
e AS (SELECT least(max(date), DATE '2001-08-31') AS thru FROM v_ledger), sb AS (SELECT category_id, CAST(-sum(amount_cents) AS BIGINT) AS sp FROM v_ledger WHERE direction='expense' AND date BETWEEN DATE '2001-08-01' AND DATE '2001-08-31' GROUP BY 1),
j AS (SELECT b.*, coalesce(sp,0) AS spent_cents, thru, greatest(1, thru-DATE '2001-08-01'+1) AS el FROM b LEFT JOIN sb USING (category_id), e),
pb AS (SELECT *, CASE WHEN el<31 THEN CAST(trunc(spent_cents*31/el) AS BIGINT) ELSE spent_cents END AS projected_cents FROM j),
bs AS (SELECT budget_id, category_id, limit_cents, spent_cents, limit_cents-spent_cents AS remaining_cents, {sql_ratio('spent_cents', 'limit_cents')} AS used_pct, projected_cents,
 CASE WHEN spent_cents>limit_cents THEN 'over' WHEN projected_cents>limit_cents THEN 'at_risk' ELSE 'on_track' END AS status, thru AS data_through FROM pb)"""


@REG.query("budget_status", f"WITH {LEDGER}, {CATEGORIES}, {BUDGETS} SELECT * FROM bs")
def budget_status(spark, sf):
    return P.budget_status(T.ledger(spark, sf), budgets(spark, sf), "2001-08")


@REG.query("dashboard_lists", all_anomalies(f"{LEDGER}, {CATEGORIES}, {BUDGETS}", "v_ledger", A.LOOKBACK_DAYS) + """
SELECT 'anomalies' AS section, type AS kind, coalesce(id,category) AS label, amount_cents AS cents, reference_cents FROM an
UNION ALL SELECT 'budgets', status, budget_id, spent_cents, limit_cents FROM bs""")
def dashboard_lists(spark, sf):
    parts = D.lists(T.ledger(spark, sf), budgets(spark, sf), "2001-08")
    odd = parts["anomalies"].select(F.lit("anomalies").alias("section"), F.col("type").alias("kind"), F.coalesce("id", "category").alias("label"), F.col("amount_cents").alias("cents"), "reference_cents")
    return odd.unionByName(parts["budgets"].select(F.lit("budgets").alias("section"), F.col("status").alias("kind"), F.col("budget_id").alias("label"),
                                                   F.col("spent_cents").alias("cents"), F.col("limit_cents").alias("reference_cents")))


def payers_budgets(spark, sf):
    return T.plan_categories(spark).select(F.concat(F.lit("b-"), "id").alias("budget_id"), F.col("id").alias("category_id"),
                                           (F.length("id") * 1500 * (1 + F.ascii("id") % 3)).cast("long").alias("limit_cents"))


# every widget of one dashboard: the cube's sections, payments that go on, anomalies, budgets
BOARD = all_anomalies(PAYMENTS.removeprefix("WITH ").rstrip() + """,
v_board AS (SELECT *, 'acct-1' AS account_id, strftime(date,'%Y-%m') AS ym FROM v_sub),
flow AS (SELECT ym AS month, sum(CASE WHEN direction='income' THEN amount_cents ELSE 0 END) AS inc, -sum(CASE WHEN direction='expense' THEN amount_cents ELSE 0 END) AS sp FROM v_board GROUP BY 1),
bud AS (SELECT 'b-'||id AS budget_id, length(id)*1500*(1+ascii(id)%3) AS limit_cents, coalesce((SELECT -sum(amount_cents) FROM v_board WHERE ym='2020-08' AND direction='expense' AND category_id=c.id),0) AS spent
 FROM (VALUES ('Streaming'),('Housing'),('Groceries'),('Gym'),('Shopping'),('Utilities')) c(id))""", "v_board", A.LOOKBACK_DAYS) + """
SELECT section, label, CAST(cents AS BIGINT) AS cents, note FROM (
 SELECT CASE month WHEN '2020-08' THEN 'current' ELSE 'previous' END AS section, 'income' AS label, inc AS cents, NULL AS note FROM flow WHERE month IN ('2020-08','2020-07')
 UNION ALL SELECT CASE month WHEN '2020-08' THEN 'current' ELSE 'previous' END, 'spending', sp, NULL FROM flow WHERE month IN ('2020-08','2020-07')
 UNION ALL SELECT 'months', month, inc-sp, NULL FROM flow WHERE month BETWEEN '2019-09' AND '2020-08'
 UNION ALL SELECT 'categories', category_id, -sum(amount_cents), NULL FROM v_board WHERE ym='2020-08' AND direction='expense' GROUP BY 2
 UNION ALL SELECT * FROM (SELECT 'merchants', merchant, -sum(amount_cents) AS c, NULL FROM v_board WHERE ym='2020-08' AND direction='expense' GROUP BY 2 ORDER BY c DESC, merchant LIMIT 5)
 UNION ALL SELECT 'recurring', label, typical_cents, kind||' '||cadence FROM every WHERE found AND active
 UNION ALL SELECT 'anomalies', coalesce(id,category), amount_cents, type FROM an
 UNION ALL SELECT 'budgets', budget_id, spent, CASE WHEN spent>limit_cents THEN 'over' ELSE 'on_track' END FROM bud)"""


@REG.query("dashboard_whole", BOARD)
def dashboard_whole(spark, sf):
    """All eight sections from one call."""
    cats = T.plan_categories(spark).withColumn("parent_id", F.lit(None).cast("string"))
    parts = D.dashboard(T.subscriptions(spark, sf), cats, payers_budgets(spark, sf), "2020-08")
    shown = {"recurring": ("label", "typical_cents", F.concat_ws(" ", "kind", "cadence")), "anomalies": (F.coalesce("id", "category"), "amount_cents", F.col("type")),
             "budgets": ("budget_id", "spent_cents", F.col("status"))}
    rows = []
    for name, df in parts.items():
        label, amount, note = shown.get(name, ("label", "cents", F.lit(None).cast("string")))
        rows.append(df.select(F.lit(name).alias("section"), (F.col(label) if isinstance(label, str) else label).alias("label"),
                              F.col(amount).cast("long").alias("cents"), note.alias("note")))
    return reduce(DataFrame.unionByName, rows)


ESSENTIAL = f"""WITH {LEDGER}, {CATEGORIES}, m AS (SELECT strftime(date,'%Y-%m') AS month, max(date) AS d,
 -sum(CASE WHEN direction='expense' THEN amount_cents ELSE 0 END) AS total, -sum(CASE WHEN direction='expense' AND essential THEN amount_cents ELSE 0 END) AS ess
 FROM v_ledger l LEFT JOIN v_path p ON p.id=l.category_id GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS rn FROM m), k AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS kn FROM r WHERE rn>1 OR d>=last_day(d)-3),
a AS (SELECT string_agg(month, ',' ORDER BY month) AS months_used, {sql_floor_div('sum(ess)', 'count(*)')} AS essential_avg_cents, {sql_floor_div('sum(total)', 'count(*)')} AS total_avg_cents FROM k WHERE kn<=3)"""


@REG.query("essential_average", f"{ESSENTIAL} SELECT * FROM a")
def essential_average(spark, sf):
    return P.essential_average(T.ledger(spark, sf), T.categories(spark, sf)).withColumn("months_used", F.array_join("months_used", ","))


def goals(spark, sf):
    k = F.col("s_suppkey")
    return T.table(spark, sf, "supplier").select(
        k.alias("goal_id"), F.when(k % 10 == 3, "emergency_fund").otherwise("savings").alias("kind"), ((k % 50) * 1000000).alias("target_cents"),
        (F.abs(T.cents(F.col("s_acctbal"))) * 10).alias("current_cents"), F.date_add(F.lit("2025-11-20").cast("date"), (k * 17).cast("int")).alias("target_date"))


GOALS = """g AS (SELECT s_suppkey AS goal_id, CASE WHEN s_suppkey%10=3 THEN 'emergency_fund' ELSE 'savings' END AS kind, (s_suppkey%50)*1000000 AS target_cents,
 abs(CAST(round(s_acctbal*100) AS BIGINT))*10 AS current_cents, DATE '2025-11-20'+CAST(s_suppkey*17 AS INTEGER) AS target_date FROM supplier)"""


@REG.query("emergency_coverage", f"""{ESSENTIAL}, {GOALS}, c AS (SELECT essential_avg_cents AS e, (SELECT arg_min(current_cents, goal_id) FROM g WHERE kind='emergency_fund') AS cur FROM a)
SELECT e AS essential_avg_cents, e*3 AS recommended_3mo_cents, e*6 AS recommended_6mo_cents, cur AS current_cents, {sql_ratio('cur', 'e', 1)} AS months_covered FROM c""")
def emergency_coverage(spark, sf):
    avg = P.essential_average(T.ledger(spark, sf), T.categories(spark, sf))
    return P.emergency_coverage(avg, goals(spark, sf))


@REG.query("goal_progress", f"""WITH {GOALS}, x AS (SELECT *, greatest(target_cents-current_cents,0) AS remaining_cents, CASE WHEN target_date>DATE '2026-01-10' THEN greatest(1,(year(target_date)-2026)*12+month(target_date)-1) END AS months_left FROM g)
SELECT goal_id, kind, target_cents, current_cents, remaining_cents, {sql_ratio('current_cents', 'target_cents')} AS progress_pct, months_left,
 CASE WHEN months_left IS NOT NULL THEN CAST(ceil(remaining_cents::DECIMAL(38,0)/months_left) AS BIGINT) END AS required_monthly_cents FROM x""")
def goal_progress(spark, sf):
    return P.goal_progress(goals(spark, sf), F.lit(dt.date(2026, 1, 10)))
