"""Batch question routing over ledgers: intent, period, entity, grounding of numbers, structured answers."""
from __future__ import annotations

import calendar
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import let
from opsloom.functions.numbers import pct, quotient
from opsloom.functions.patterns import occurs
from opsloom.functions.rules import first_match

# fixed values: question pattern -> intent, first match wins
INTENTS = [
    (r"subscri|recurring|bills?\b|repeat", "recurring"),
    (r"unusual|anomal|weird|suspicious|spike|strange|unexpected|odd ", "anomalies"),
    (r"budget", "budgets"), (r"emergency", "emergency"), (r"debt|pay ?off|loan", "debt"),
    (r"advice|recommend|save money|cut back|reduce|improve|suggest|tips?\b|how can i save", "recommend"),
    (r"savings rate|how much (did|have) i save|did i save|saved", "savings"),
    (r"compare|versus|\bvs\.?\b|trend|change|more than|less than|increase|decrease", "compare"),
    (r"top|biggest|largest|most|where (does|did) my money", "top"),
    (r"income|earn|salary|paid me|got paid", "income"),
]
SPEND = r"spen|cost|pay|paid|much|total"
OVERVIEW = r"spen|expens|cash ?flow|summary|overview|how am i doing|how did i do"
# fixed values: words that name a category
CATEGORY_WORDS = {
    "Dining & Coffee": ["dining", "restaurant", "restaurants", "eating out", "takeout", "coffee", "food delivery"],
    "Groceries": ["grocery", "groceries", "supermarket"],
    "Fuel": ["gas", "fuel", "gasoline", "petrol"],
    "Housing": ["rent", "mortgage", "housing"],
    "Utilities": ["utilities", "electric", "electricity", "water bill"],
    "Phone & Internet": ["phone", "internet", "cell"],
    "Subscriptions": ["subscriptions", "streaming"],
    "Transportation": ["transport", "transportation", "uber", "parking"],
    "Shopping": ["shopping"], "Entertainment": ["entertainment"], "Travel": ["travel", "vacation"],
    "Healthcare": ["health", "healthcare", "medical", "pharmacy"], "Insurance": ["insurance"],
}
NOT_NAMED = ("transfer", "other income", "uncategorized")
NUMBER = r"(?<![A-Za-z])(-?\$?\d[\d,]*(?:\.\d+)?%?)"
MONTHS = {**{n.lower(): i for i, n in enumerate(calendar.month_name) if n}, **{n.lower(): i for i, n in enumerate(calendar.month_abbr) if n}}
MONTH_PATTERN = r"\b(" + "|".join(sorted(MONTHS, key=lambda m: (-len(m), m))) + r")\b\.?\s*(\d{4})?"


def route_intent(question: Column, names_entity: Column) -> Column:
    """Intent of a question; one that names a category or merchant beside a spending word is about spending."""
    def route(q: Column) -> Column:
        return F.coalesce(F.when(names_entity & occurs(q, SPEND, True), F.lit("spend")), first_match(q, INTENTS),
                          F.when(occurs(q, OVERVIEW, True), F.lit("overview")), F.lit("help"))
    return let(F.lower(F.trim(question)), route)


def extract_period(questions: DataFrame, today: Column, latest: Column) -> DataFrame:
    """Add period_start, period_end and explicit for ``question``; without a period the latest data month."""
    q = F.lower("question")
    month_start = F.trunc(today, "month")
    n = F.regexp_extract(q, r"last (\d{1,2}) months", 1)
    name, year_text = F.regexp_extract(q, MONTH_PATTERN, 1), F.regexp_extract(q, MONTH_PATTERN, 2)
    number = reduce(lambda acc, m: acc.when(name == m[0], m[1]), MONTHS.items(), F.when(F.lit(False), 0))
    year = F.when(year_text != "", F.when(year_text != "", year_text).cast("int")).when(number <= F.month(today), F.year(today)).otherwise(F.year(today) - 1)
    named = (name != "") & ~((name == "may") & (year_text == "") & q.rlike(r"\bmay (i|we)\b"))
    named_start = F.make_date(year, number, F.lit(1))
    in_year = F.regexp_extract(q, r"\b(in|during|for) (\d{4})\b", 2)
    whole = lambda y: (F.make_date(y, F.lit(1), F.lit(1)), F.make_date(y, F.lit(12), F.lit(31)))
    year_or_null = F.when(in_year != "", in_year).cast("int")
    n_or_null = F.when(n != "", n).cast("int")
    has = lambda t: F.contains(q, F.lit(t))
    cases = [
        (has("last month") | has("previous month"), F.add_months(month_start, -1), F.date_sub(month_start, 1)),
        (has("this month"), month_start, today),
        (has("last year"), *whole(F.year(today) - 1)),
        (has("this year") | has("ytd") | has("year to date"), F.make_date(F.year(today), F.lit(1), F.lit(1)), today),
        (n != "", F.add_months(month_start, -n_or_null), F.date_sub(month_start, 1)),
        (named, named_start, F.last_day(named_start)),
        (in_year != "", *whole(year_or_null)),
    ]
    pick = lambda i: reduce(lambda acc, c: acc.when(c[0], c[i]), cases, F.when(F.lit(False), today))
    explicit = reduce(lambda a, b: a | b, [c[0] for c in cases])
    return questions.withColumn("period_start", pick(1).otherwise(F.trunc(latest, "month"))).withColumn(
        "period_end", pick(2).otherwise(F.last_day(latest))).withColumn("explicit", explicit)


def find_category(question: Column, names: Column) -> Column:
    """Longest of the category ``names`` (an array; a ledger's categories) inside the text, else by category words."""
    q = F.lower(question)
    usable = F.filter(names, lambda n: F.contains(q, F.lower(n)) & ~F.lower(n).isin(*NOT_NAMED))
    longest = F.array_sort(F.transform(usable, lambda n: F.struct((-F.length(n)).alias("l"), n.alias("n"))))
    worded = reduce(lambda acc, kv: acc.when(q.rlike(r"\b(" + "|".join(kv[1]) + r")\b"), kv[0]), CATEGORY_WORDS.items(), F.when(F.lit(False), ""))
    return F.coalesce(F.try_element_at(longest, F.lit(1))["n"], worded)


def find_entities(questions: DataFrame, merchants: DataFrame, max_words: int = 8) -> DataFrame:
    """Add ``merchant``: the longest known merchant (3 characters or more) that stands in the question as whole words.

    Questions and merchant names are cut into words alike; every run of up to ``max_words`` words of a question
    meets the names in one equi-join, so no question is tested against a name it does not contain. A merchant of
    more words than that is compared through its first ``max_words`` and then checked whole.
    """
    def cut(text: Column) -> Column:
        return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")

    def runs_of(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(w)), lambda i: i <= F.size(w))  # an empty list counts down from 1 to 0
        longest = lambda i: F.least(F.lit(max_words), F.size(w) - i + 1)
        return F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), longest(i)), lambda n: F.array_join(F.slice(w, i, n), " ")))))

    # only ids and runs move; a text comes back for the names that met one of its runs
    words = questions.select("question_id", cut(F.col("question")).alias("w")).filter(F.size("w") > 0)
    runs = words.select("question_id", F.explode(runs_of(F.col("w"))).alias("run"))
    known = merchants.select("merchant").distinct().filter(F.length("merchant") >= 3).select(
        "merchant", F.array_join(F.slice(cut(F.col("merchant")), 1, max_words), " ").alias("run")).filter("run <> ''")
    # the name itself, with its own punctuation, must stand between word borders
    whole = F.concat(F.lit(r"(^|[^\p{L}\p{N}_])"), F.regexp_replace(F.lower("merchant"), r"([\\.\[\]{}()*+?^$|-])", r"\\$1"), F.lit(r"($|[^\p{L}\p{N}_])"))
    met = runs.join(known, "run").select("question_id", "merchant").distinct()
    hit = questions.select("question_id", "question").join(met, "question_id").filter(F.call_function("rlike", F.lower("question"), whole))
    best = hit.groupBy("question_id").agg(F.max_by("merchant", F.struct(F.length("merchant"), "merchant")).alias("merchant"))
    return questions.join(best, "question_id", "left")


def numbers_in(text: Column) -> Column:
    """Distinct numbers of a text without $ , % and sign, as two-decimal text."""
    plain = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), 1),
                        lambda n: F.regexp_replace(n, r"[$,%\-]", ""))
    return F.array_distinct(F.transform(F.filter(plain, lambda n: n != ""), lambda n: n.try_cast("decimal(38,2)").cast("string")))


def grounded(rewritten: Column, source: Column) -> Column:
    """True when every number of the rewritten text occurs in its source."""
    return F.size(F.array_except(numbers_in(rewritten), numbers_in(source))) == 0


BLOCK_STEP, BLOCK_LEVELS = 4, 5


def _blocks_of_day(day: Column) -> Column:
    """The block of each level (of 1, 4, 16, 64 and 256 days) that holds a day."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(day / BLOCK_STEP ** k).alias("block")) for k in range(BLOCK_LEVELS)])


def _blocks_of_span(first: Column, last: Column) -> Column:
    """The fewest blocks that make up the days from ``first`` to ``last``: at most six of a level, and whole ones of the largest."""
    parts = []
    for k in range(BLOCK_LEVELS):
        lo, hi = F.ceil(first / BLOCK_STEP ** k), F.floor((last + 1) / BLOCK_STEP ** k)
        up_lo, up_hi = F.ceil(first / BLOCK_STEP ** (k + 1)), F.floor((last + 1) / BLOCK_STEP ** (k + 1))
        covered = (up_lo < up_hi) if k + 1 < BLOCK_LEVELS else F.lit(False)

        def run(a: Column, b: Column, k: int = k) -> Column:
            numbers = F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(numbers, lambda n: F.struct(F.lit(k).alias("level"), n.alias("block")))
        parts += [run(lo, F.when(covered, up_lo * BLOCK_STEP).otherwise(hi)), run(F.when(covered, up_hi * BLOCK_STEP).otherwise(hi), hi)]
    return F.concat(*parts)


def spend_answers(questions: DataFrame, ledger: DataFrame) -> DataFrame:
    """Facts per question about a merchant or category over its period: total, count, refunds, share, largest, has_data.

    questions: question_id, merchant (or null), category_id (or null), period_start, period_end; a merchant goes before a
    category, a question that names neither has zeros. ``has_data`` is false when the period holds no ledger row at all, so
    that "nothing spent" and "no data" differ. A period that ends before it starts or lacks an end holds nothing.

    Sums and smallest amounts are kept per entity (merchant, category, whole ledger) for blocks of 1, 4, 16, 64 and 256
    days. A period is a few blocks (a month at most nine, a year about a dozen), met by one equi-join; equal questions about
    one entity and period are answered once. Neither the days of an entity nor those of a period are gone through.
    """
    spent = F.col("direction") == "expense"
    cents = F.when(spent, F.col("amount_cents"))
    sums = lambda: [F.sum("net").alias("net"), F.sum("n").alias("n"), F.sum("refunds").alias("refunds"), F.sum("seen").alias("seen"), F.min("big").alias("big")]
    entity = lambda kind, name: F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"))
    whole = entity("all", F.lit(""))
    daily = ledger.filter(F.col("date").isNotNull()).groupBy("merchant", "category_id", "date").agg(
        F.coalesce(F.sum(cents), F.lit(0)).alias("net"), F.count(cents).alias("n"), F.coalesce(F.sum(F.when(cents > 0, cents)), F.lit(0)).alias("refunds"),
        F.count("*").alias("seen"), F.min(F.when(spent, F.struct("amount_cents", "merchant", "date"))).alias("big"))
    facts = ["net", "n", "refunds", "seen", "big"]
    per_day = daily.select("date", *facts, F.explode(F.array(entity("merchant", F.col("merchant")), entity("category", F.col("category_id")), whole)).alias("entity")).filter(
        F.col("entity.name").isNotNull()).groupBy("entity", "date").agg(*sums())
    blocks = per_day.select("entity", *facts, F.explode(_blocks_of_day(F.unix_date("date"))).alias("at")).groupBy("entity", "at").agg(*sums())

    about = F.when(F.col("merchant").isNotNull(), entity("merchant", F.col("merchant"))).when(F.col("category_id").isNotNull(), entity("category", F.col("category_id")))
    # entity and period travel as one value, and nothing is filtered by its parts: a filter would be pushed down to the questions
    # and work out their period and category once more
    span = lambda e: F.struct(e.alias("entity"), "period_start", "period_end")
    asked = questions.select("question_id", span(about).alias("own"), span(whole).alias("every"))
    spans = asked.select(F.explode(F.array("own", "every")).alias("span")).distinct()
    probes = spans.select("span", F.col("span.entity").alias("entity"), F.explode(_blocks_of_span(F.unix_date("span.period_start"), F.unix_date("span.period_end"))).alias("at"))
    found = probes.join(blocks, ["entity", "at"]).groupBy("span").agg(*sums())
    all_of = found.select(F.col("span").alias("every"), (-F.col("net")).alias("all_cents"), F.col("seen").alias("all_seen"))
    zero = F.lit(0).cast("long")
    out = asked.join(found.withColumnRenamed("span", "own"), "own", "left").join(all_of, "every", "left").withColumn("total_cents", F.coalesce(-F.col("net"), zero))
    return out.select("question_id", "total_cents", F.coalesce("n", zero).alias("count"), F.coalesce("refunds", zero).alias("refund_cents"),
                      pct(F.col("total_cents"), F.coalesce("all_cents", zero)).alias("share_pct"), (-F.col("big.amount_cents")).alias("largest_cents"),
                      F.col("big.merchant").alias("largest_merchant"), F.col("big.date").alias("largest_date"), (F.coalesce("all_seen", zero) > 0).alias("has_data"))


def recommendations(summary: DataFrame, breakdown: DataFrame, subscriptions: DataFrame, budgets: DataFrame) -> DataFrame:
    """Advice as facts (kind, subject, cents): low savings rate, subscriptions, two largest discretionary
    categories at a fifth, fees, budgets that are over. Inputs are the outputs of the ledger operators."""
    low = summary.filter(F.col("savings_rate_pct") < 10).select(
        F.lit("low_savings_rate").alias("kind"), F.lit(None).cast("string").alias("subject"), F.col("net_cents").alias("cents"))
    subs = subscriptions.filter(F.col("active") & (F.col("kind") == "subscription")).agg(
        F.count("*").alias("n"), F.sum("annual_cost_cents").alias("c")).filter("n > 0").select(
        F.lit("subscriptions").alias("kind"), F.col("n").cast("string").alias("subject"), (-F.col("c")).alias("cents"))
    cut = breakdown.filter(~F.col("essential") & ~F.col("category").isin("Uncategorized", "Fees & Interest")).orderBy(
        F.desc("amount_cents"), "category").limit(2).select(
        F.lit("cut_by_a_fifth").alias("kind"), F.col("category").alias("subject"), quotient(F.col("amount_cents"), F.lit(5)).alias("cents"))
    fees = breakdown.filter(F.col("category") == "Fees & Interest").select(F.lit("fees").alias("kind"), F.col("category").alias("subject"), F.col("amount_cents").alias("cents"))
    over = budgets.filter(F.col("status") == "over").select(F.lit("over_budget").alias("kind"), F.col("category_id").alias("subject"), (-F.col("remaining_cents")).alias("cents"))
    return low.unionByName(subs).unionByName(cut).unionByName(fees).unionByName(over)
