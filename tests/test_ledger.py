"""Hand-computed ledger cases."""
import datetime as dt
import statistics

import pandas as pd
import pytest
from pyspark.sql import functions as F

from opsloom.functions import merchant as M
from opsloom.functions.rules import BUILTIN_CATEGORIES, kind_of
from opsloom.operators import anomalies as A
from opsloom.operators import categories as C
from opsloom.operators import categorize as G
from opsloom.operators import imports as I
from opsloom.operators import planning as P
from opsloom.operators import recurring as R
from opsloom.operators import summaries as Q

MONTH = [
    (1, "RENT PAYMENT OAK APARTMENTS", -165000), (2, "ACME CORP PAYROLL DIRECT DEP", 412500), (3, "NETFLIX.COM 866-579-7172 CA", -1599),
    (5, "KROGER #1234 COLUMBUS OH", -8734), (5, "STARBUCKS STORE 05521 COLUMBUS OH", -575), (5, "STARBUCKS STORE 05521 COLUMBUS OH", -575),
    (9, "SHELL OIL 57444 COLUMBUS OH", -4210), (12, "DUKE ENERGY PAYMENT", -11240), (15, "SPOTIFY USA", -1199),
    (16, "ACME CORP PAYROLL DIRECT DEP", 412500), (20, "CHASE CREDIT CRD AUTOPAY", -50000), (22, "TRANSFER TO SAVINGS", -40000),
    (25, "AMZN MKTP US*2K4L91", -3899),
]


def raw_rows(months, extra=()):
    rows = [(dt.date(2026, m, d), text, cents) for m in months for d, text, cents in MONTH]
    return sorted(rows + list(extra), key=lambda r: r[0])


@pytest.fixture(scope="module")
def ledger(spark):
    extra = [(dt.date(2026, 4, 26), "SHELL OIL 57444 COLUMBUS OH", -42100), (dt.date(2026, 4, 20), "BEST BUY 00123", -12999), (dt.date(2026, 4, 21), "BEST BUY 00123", -12999)]
    rows = [(f"t{i:03d}", i, d, t, c) for i, (d, t, c) in enumerate(raw_rows((1, 2, 3, 4), extra))]
    df = spark.createDataFrame(rows, "id string, line_no long, date date, description string, amount_cents long").withColumn("merchant", M.normalize_merchant(F.col("description")))
    return G.categorize(df).withColumn("category_id", F.col("category")).withColumn("account_id", F.lit("a1")).withColumn("status", F.lit("parsed")).cache()


@pytest.fixture(scope="module")
def cats(spark):
    rows = [(n, n, None, k, e, n) for n, k, e in BUILTIN_CATEGORIES]
    return spark.createDataFrame(rows, "id string, name string, parent_id string, kind string, essential boolean, group string")


@pytest.mark.parametrize("raw,name", [
    ("STARBUCKS STORE 05521 COLUMBUS OH", "Starbucks"), ("AMZN MKTP US*2K4L91", "Amazon"),
    ("PURCHASE AUTHORIZED ON 01/05 SQ *BLUE BOTTLE COFFEE 123456 SAN FRANCISCO CA", "Blue Bottle Coffee"), ("TST* BLUE DOOR CAFE", "Blue Door Cafe"),
    ("KROGER #1234 COLUMBUS OH", "Kroger"), ("DEBIT CARD PURCHASE XXXX1234 JOE'S HARDWARE 555-123-4567", "Joe's Hardware"),
    ("NETFLIX.COM 866-579-7172 CA", "Netflix"), ("POS DEBIT LOCAL PIZZA SHOP", "Local Pizza Shop"), ("", "Unknown"), ("AMAZON PRIME*2A", "Amazon Prime"),
])
def test_merchant_names(spark, raw, name):
    assert spark.createDataFrame([(raw,)], "t string").select(M.normalize_merchant(F.col("t"))).first()[0] == name


def test_categories_and_directions(ledger):
    got = {r.merchant: (r.category, r.direction) for r in ledger.collect()}
    assert got["Rent Payment Oak Apartments"] == ("Housing", "expense")
    assert got["Acme Corp Payroll Direct Dep"] == ("Salary", "income")
    assert got["Netflix"][0] == "Subscriptions" and got["Kroger"][0] == "Groceries" and got["Starbucks"][0] == "Dining & Coffee" and got["Shell"][0] == "Fuel"
    assert {r.category for r in ledger.filter("direction = 'transfer'").collect()} == {"Transfer", "Credit Card Payment"}


def test_summary_of_one_month(ledger):
    r = Q.summary(ledger, "2026-01-01", "2026-01-31").first()
    assert (r.income_cents, r.spending_cents, r.transfers_excluded, r.savings_rate_pct) == (825000, 197031, 2, 76.1)
    april = Q.summary(ledger, "2026-04-01", "2026-04-30").first()
    assert april.spending_cents == 197031 + 42100 + 25998


def test_breakdown_and_merchants(ledger, cats):
    rows = {r.category: r for r in Q.category_breakdown(ledger, cats, "2026-01-01", "2026-01-31").collect()}
    assert rows["Housing"].amount_cents == 165000 and rows["Dining & Coffee"]["count"] == 2
    assert abs(sum(r.share_pct for r in rows.values()) - 100) <= 0.5
    assert Q.top_merchants(ledger, cats, "2026-01-01", "2026-01-31", 3).orderBy(F.desc("amount_cents")).first().merchant == "Rent Payment Oak Apartments"
    change = {r.category: r.change_cents for r in Q.compare_periods(ledger, cats, ("2026-04-01", "2026-04-30"), ("2026-03-01", "2026-03-31")).collect()}
    assert change["Fuel"] == 42100


def test_year_over_year_and_report(ledger, cats):
    rows = {r.month: r for r in Q.year_over_year(ledger, 2026).collect()}
    assert rows["01"].spending_cents == 197031 and not rows["01"].prev_has_data and not rows["12"].has_data
    report = {r.category: r for r in Q.monthly_report(ledger, cats, 2026).collect()}
    assert report["Housing"].total == 660000 and report["NET CASH FLOW"].m01 == 825000 - 197031


def test_recurring(ledger, cats):
    found = {r.label: r for r in R.recurring(ledger, cats).collect()}
    assert found["Netflix"].kind == "subscription" and found["Netflix"].cadence == "monthly" and found["Netflix"].typical_cents == -1599
    assert found["Netflix"].annual_cost_cents == -int(1599 * 365 / 30.4)
    assert found["Rent Payment Oak Apartments"].kind == "bill" and found["Acme Corp Payroll Direct Dep"].kind == "income"
    assert "Starbucks" not in found


def test_anomalies(ledger):
    got = {(r.type, r.merchant or r.category) for r in A.anomalies(ledger).collect()}
    assert {("merchant_outlier", "Shell"), ("possible_duplicate_charge", "Best Buy"), ("category_spike", "Fuel")} <= got
    assert not any("Starbucks" in str(x[1]) for x in got)


@pytest.mark.parametrize("prices", [[1000, 2000, 5000, 9000, 30000], [700, 10 ** 6, 10 ** 6 + 3000, 10 ** 9, 10 ** 12], [3000, 8191, 8192, 16383, 16384, 40000]])
def test_outliers_equal_brute_force(spark, prices):
    import random
    rng = random.Random(5)
    rows = [(f"x{i:04d}", dt.date(2026, 1, 1) + dt.timedelta(days=rng.randrange(120)), rng.choice("abc"), -int(rng.choice(prices) * rng.uniform(0.5, 2)),
             "expense", "a1", "c") for i in range(400)]
    df = spark.createDataFrame(rows, "id string, date date, merchant string, amount_cents long, direction string, account_id string, category_id string")
    end = max(r[1] for r in rows)
    want = set()
    for t in rows:
        if t[1] < end - dt.timedelta(days=60):
            continue
        hist = [-x[3] for x in rows if x[2] == t[2] and x[0] != t[0] and x[1] <= t[1]]
        if len(hist) < 3:
            continue
        med = statistics.median(hist)
        mad = statistics.median([abs(h - med) for h in hist]) or max(med * 0.1, 100)
        if -t[3] > med + 4 * mad and -t[3] > med * 1.5 and -t[3] - med >= 2000:
            want.add((t[0], int(med), len(hist)))
    got = {(r.id, r.usual_cents, r.history_count) for r in A.merchant_outliers(df, 60).collect()}
    assert got == want and want


def test_price_ranges_cover_every_amount(spark):
    import numpy as np
    amounts = sorted({v + d for e in range(62) for v in (2 ** e, 3 * 2 ** e // 2) for d in (-1, 0, 1) if v + d > 0})
    rows = spark.createDataFrame([(a,) for a in amounts], "a long").select("a", A.price_range(F.col("a")).alias("r")).collect()
    low, high = A.range_bounds(np.array([r.r for r in rows], np.int64))
    assert all(lo <= r.a <= hi for r, lo, hi in zip(rows, low.tolist(), high.tolist()))
    assert [r.r for r in sorted(rows)] == sorted(r.r for r in rows)


def greedy_streams(amounts):
    streams = []
    for a in sorted(amounts):
        for st in streams:
            med = statistics.median(st)
            if abs(a - med) <= max(200, med * 0.20):
                st.append(a)
                break
        else:
            streams.append([a])
    return streams


def test_price_bands_equal_the_plain_model():
    import random
    rng = random.Random(3)
    for trial in range(200):
        size = rng.randrange(1, 400 if trial % 4 == 0 else 40)
        amounts = [rng.choice([300, 500, 1299, 2599, 2600, 9900]) + rng.randrange(0, 900) for _ in range(size)]
        counted = pd.Series(amounts).value_counts().sort_index()
        frame = pd.DataFrame({"merchant": "m", "cents": counted.index.astype("int64"), "n": counted.to_numpy("int64")})
        frame = pd.concat([frame, frame.assign(merchant="n")], ignore_index=True)
        cuts = sorted(rng.sample(range(len(frame) + 1), min(3, len(frame))))
        parts = [frame.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, len(frame)])]
        placed = pd.concat(R._bands_of(["merchant"])(iter(parts)))
        want = {a: i for i, st in enumerate(greedy_streams(amounts)) for a in st}
        for name in "mn":
            assert dict(placed[placed.merchant == name][["cents", "band"]].itertuples(index=False, name=None)) == want


def plain_plans(days):
    plans, out = [], []
    for day, n in days:
        hit = next((i for i, p in enumerate(plans) if abs(statistics.median(p) - day) <= 4), len(plans))
        if hit == len(plans):
            plans.append([])
        plans[hit] += [day] * n
        out.append(hit)
    return out if len(plans) <= 4 and all(len(p) >= 2 for p in plans) else [0] * len(days)


def test_billing_days_equal_the_plain_model(spark):
    import random
    rng = random.Random(4)
    streams = {}
    for s in range(60):
        centres = rng.sample([2, 9, 15, 21, 28], rng.randrange(1, 6))
        days = {dt.date(2026, m, min(28, max(1, c + rng.randrange(-2, 3)))) for m in range(1, 9) for c in centres}
        streams[s] = [(d, rng.choice([1, 1, 1, 2, 5])) for d in sorted(days)]
    rows = [(s, d, d.day, n) for s, ds in streams.items() for d, n in ds]
    df = spark.createDataFrame(rows, "s int, date date, day int, n long")
    held = df.groupBy("s").agg(F.array_sort(F.collect_list(F.struct("date", "day", "n"))).alias("days"))
    got = {r.s: [p.plan for p in r.plans] for r in held.select("s", R._billing_plans(F.col("days")).alias("plans")).collect()}
    want = {s: plain_plans([(d.day, n) for d, n in ds]) for s, ds in streams.items()}
    assert got == want and len({max(p) for p in want.values()}) >= 4


def test_two_plans_of_one_merchant(spark, cats):
    def monthly(day, cents, merchant):
        return [(f"{merchant}{day}-{m}-{cents}", dt.date(2026, m, day), merchant, -cents, "expense", "Subscriptions") for m in range(5, 11)]
    rows = monthly(3, 299, "Apple") + monthly(3, 1099, "Apple") + monthly(15, 1179, "Spotify") + monthly(22, 1179, "Spotify")
    df = spark.createDataFrame(rows, "id string, date date, merchant string, amount_cents long, direction string, category_id string")
    labels = {r.label for r in R.recurring(df, cats).filter("kind = 'subscription'").collect()}
    assert labels == {"Apple ($2.99)", "Apple ($10.99)", "Spotify (billed ~15th)", "Spotify (billed ~22nd)"}


def test_planning(ledger, cats, spark):
    budgets = spark.createDataFrame([("b1", "Dining & Coffee", 1000), ("b2", "Groceries", 20000)], "budget_id string, category_id string, limit_cents long")
    rows = {r.budget_id: r for r in P.budget_status(ledger, budgets, "2026-02").collect()}
    assert (rows["b1"].status, rows["b1"].spent_cents) == ("over", 1150) and (rows["b2"].status, rows["b2"].remaining_cents) == ("on_track", 11266)
    avg = P.essential_average(ledger, cats).first()
    assert avg.months_used == ["2026-01", "2026-02", "2026-03"] and avg.essential_avg_cents == 165000 + 8734 + 4210 + 11240


def staged(spark, rows, name):
    data = [(name, "a1", i + 1, d, t, c) for i, (d, t, c) in enumerate(rows)]
    return I.fingerprint(spark.createDataFrame(data, "import_id string, account_id string, line_no long, date date, description string, amount_cents long")).withColumn("id", F.concat("import_id", F.col("line_no").cast("string")))


def test_repeats_kept_and_overlap_dropped(spark):
    first = staged(spark, raw_rows((1,)), "one")
    none = first.filter("false")
    committed = I.commit_rows(I.flag_duplicates(first, none), none)
    assert committed.count() == 13
    second = staged(spark, raw_rows((1,))[-3:] + [(dt.date(2026, 2, 1), "NEW A", -1), (dt.date(2026, 2, 2), "NEW B", -2)], "two")
    flagged = I.flag_duplicates(second, committed)
    counts = I.commit_counts(flagged, I.commit_rows(flagged, committed)).first()
    assert (counts.rows_new, counts.rows_duplicate, counts.rows_skipped) == (2, 3, 0)
    assert I.rollback(committed, ["one"]).count() == 0


def test_late_difference_collides_only_where_the_text_is_cut(spark):
    long = "A" * 40
    given = staged(spark, [(dt.date(2026, 1, 1), long + "X", -5), (dt.date(2026, 1, 1), long + "Y", -5)], "c")
    for rows, kept in ((I.fingerprint(given.drop("occurrence", "fingerprint"), text_chars=40), 1), (given, 2)):
        assert rows.select("fingerprint").distinct().count() == kept and {r.occurrence for r in rows.collect()} == {0}
        none = rows.filter("false")
        assert I.commit_rows(I.flag_duplicates(rows, none), none).count() == kept


def test_tree_moves_and_duplicates(spark):
    cats = spark.createDataFrame([("u", "k1", "Kids", None, None, "import"), ("u", "k2", "kids", None, None, None), ("u", "a", "Allowance", "k1", "-", "import"),
                                  ("u", "b", "allowance", "k2", None, None), (None, "Fuel", "Fuel", None, None, None)],
                                 "user_id string, id string, name string, parent_id string, system_group string, origin string")
    txns = spark.createDataFrame([("u", "t1", "k1")], "user_id string, id string, category_id string")
    merged = {(r.src_id, r.dst_id) for r in C.dedupe_categories(cats, txns).collect()}
    assert merged == {("k2", "k1"), ("b", "a")}
    refused = {r.reason for r in C.refused_moves(cats, spark.createDataFrame([("k1", "a")], "id string, new_parent_id string")).collect()}
    assert refused == {"under its own descendant"}
    groups = {r.id: r.effective_group for r in C.category_groups(cats).collect()}
    assert groups["a"] is None and groups["Fuel"] == "Fuel"
    hidden = spark.createDataFrame([], "user_id string, category_id string")
    seen = {r.id for r in C.visible_categories(cats, hidden, cats.filter("user_id is not null").select("user_id").distinct()).collect()}
    assert seen == {"k1", "k2", "a", "b", "Fuel"}


def test_merge_moves_everything(spark):
    txns = spark.createDataFrame([("u", "t1", "x", -5, "income")], "user_id string, id string, category_id string, amount_cents long, direction string")
    rules = spark.createDataFrame([("u", "r", "x")], "user_id string, rule_id string, category_id string")
    budgets = spark.createDataFrame([("u", "b1", "x"), ("u", "b2", "y")], "user_id string, id string, category_id string")
    cats = spark.createDataFrame([("u", "x", "X", None, "income"), ("u", "y", "Y", None, "expense"), ("u", "z", "Z", "x", "expense")],
                                 "user_id string, id string, name string, parent_id string, kind string")
    out = C.merge_categories(txns, rules, budgets, cats, spark.createDataFrame([("u", "x", "y")], "user_id string, src_id string, dst_id string"))
    t = out["transactions"].first()
    assert (t.category_id, t.direction) == ("y", "expense") and out["rules"].first().category_id == "y"
    assert [r.id for r in out["budgets"].collect()] == ["b2"]
    assert {r.id: r.parent_id for r in out["categories"].collect()} == {"y": None, "z": "y"}


def test_kinds(spark):
    assert spark.range(1).select(kind_of(F.lit("Transfer"))).first()[0] == "transfer"


def test_deep_trees_settle(spark):
    rows = [("u", f"{side}{n:02}", f"level {n}" if side == "a" else f"Level {n}", f"{side}{n - 1:02}" if n else None, "Top" if n == 0 else None, None)
            for side in "ab" for n in range(9)]
    cats = spark.createDataFrame([*rows, ("u", "x", "loop", "y", None, None), ("u", "y", "round", "x", None, None), ("u", "z", "lost", "gone", None, None)],
                                 "user_id string, id string, name string, parent_id string, system_group string, origin string")
    txns = spark.createDataFrame([], "user_id string, id string, category_id string")
    assert {(r.src_id, r.dst_id) for r in C.dedupe_categories(cats, txns).collect()} == {(f"a{n:02}", f"b{n:02}") for n in range(9)}
    groups = {r.id: r.effective_group for r in C.category_groups(cats).collect()}
    assert groups == {r[1]: "Top" for r in rows} | {"x": None, "y": None, "z": None}
    moves = spark.createDataFrame([("a00", "a08"), ("a00", "b08"), ("x", "y")], "id string, new_parent_id string")
    assert {(r.id, r.new_parent_id, r.reason) for r in C.refused_moves(cats, moves).collect()} == {
        ("a00", "a08", "under its own descendant"), ("x", "y", "under its own descendant")}
