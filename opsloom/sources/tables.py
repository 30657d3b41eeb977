"""Domain views over the star-schema tables: the operators' inputs when no other feed is given.

Each binding is a projection (plus one key join where a name lives in a dimension), so column pruning and
filters reach the parquet scan.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.functions.numbers import cents
from opsloom.schemas import TABLES
from opsloom.session import spread


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def text_of(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as expenses (returns are refunds), orders as income or transfers."""
    line = table(spark, folder, "lineitem")
    part = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    key = F.col("l_orderkey")
    spent = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        text_of("L", key.cast("string"), "-", F.col("l_partkey").cast("string"), "-",
                F.col("l_suppkey").cast("string"), "-", F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.when(F.col("l_returnflag") == "R", 1).otherwise(-1) * cents(F.col("l_extendedprice"))).alias("amount_cents"),
        F.lit("expense").alias("direction"),
        F.when(F.col("l_quantity") != 1, F.col("p_type")).alias("category_id"),
        F.col("p_brand").alias("merchant"),
        F.upper(text_of(F.col("p_brand"), " ", F.col("p_name"))).alias("description"),
        F.when(F.col("l_linestatus") == "F", "reviewed").otherwise("parsed").alias("status"),
        F.element_at(F.array(*[F.lit(x) for x in ("user", "rule", "import", "none")]),
                     (F.pmod(F.col("l_linenumber"), F.lit(4)) + 1).cast("int")).alias("category_source"),
        (F.pmod(key, F.lit(50))).alias("account_no"),
        ((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0.08)).alias("excluded"),
        F.col("l_linenumber").cast("int").alias("source_line"),
    )
    order = table(spark, folder, "orders")
    transfer = F.col("o_orderstatus") == "P"
    moved = order.select(
        text_of("O", F.col("o_orderkey").cast("string")).alias("id"),
        F.col("o_orderdate").cast("date").alias("date"),
        cents(F.col("o_totalprice")).alias("amount_cents"),
        F.when(transfer, "transfer").otherwise("income").alias("direction"),
        F.when(transfer, "Transfer").otherwise("Income").alias("category_id"),
        text_of("Payer ", F.col("o_orderpriority")).alias("merchant"),
        F.upper(text_of("deposit ", F.col("o_orderpriority"))).alias("description"),
        F.lit("parsed").alias("status"),
        F.lit("rule").alias("category_source"),
        F.pmod(F.col("o_orderkey"), F.lit(50)).alias("account_no"),
        F.lit(False).alias("excluded"),
        F.lit(0).alias("source_line"),
    )
    both = spent.unionByName(moved)
    return (
        both.withColumn("account_id", text_of("acct-", F.col("account_no").cast("string")))
        .withColumn("user_id", text_of("u", (F.col("account_no") % 10).cast("string")))
        .withColumn("import_id", text_of("imp-", F.col("account_no").cast("string"), "-", F.year("date").cast("string")))
        .drop("account_no")
    )


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    """What analytics see: every transaction that is not excluded."""
    return transactions(spark, folder).filter(~F.col("excluded"))


def categories(spark: SparkSession, folder: str) -> DataFrame:
    """Category dimension of the ledger: part types under two parents, plus the two fixed ones."""
    types = table(spark, folder, "part").select(F.col("p_type").alias("id")).distinct().select(
        "id", F.col("id").alias("name"),
        F.when(F.col("id").isin("LARGE", "MEDIUM", "SMALL"), "Goods")
        .when(F.col("id").isin("PROMO", "ECONOMY"), "Deals").alias("parent_id"),
        F.lit("expense").alias("kind"), F.col("id").isin("ECONOMY", "STANDARD").alias("essential"))
    fixed = spark.sql("""SELECT * FROM VALUES
        ('Goods', 'Goods', CAST(NULL AS STRING), 'expense', false), ('Deals', 'Deals', NULL, 'expense', false),
        ('Income', 'Income', NULL, 'income', false), ('Transfer', 'Transfer', NULL, 'transfer', false)
        AS t(id, name, parent_id, kind, essential)""")
    return types.unionByName(fixed)


def charges(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases and clicks as small card charges; the merchant is the type and the last digit of ``k``."""
    ev = table(spark, folder, "events").filter(F.col("event_type").isin("purchase", "click"))
    k = F.get_json_object("props", "$.k").cast("int")
    return ev.select(
        text_of("E", F.col("event_id").cast("string")).alias("id"),
        F.col("event_id").alias("line_no"),
        F.col("ts").cast("date").alias("date"),
        (-cents(F.col("value"))).alias("amount_cents"),
        text_of(F.col("event_type"), "-", (k % 10).cast("string")).alias("merchant"),
        F.upper(text_of(F.col("event_type"), " ref #", k.cast("string"), " shop")).alias("description"),
        text_of("acct-", (F.col("user_id") % 20).cast("string")).alias("account_id"),
        F.lit("expense").alias("direction"),
        F.when(k % 10 < 3, "Streaming").when(k % 10 < 6, "Groceries").otherwise("Shopping").alias("category_id"),
    )


def log_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as log lines: host from the user, program from the type, a message with the key."""
    ev = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k")
    return ev.select(
        F.col("event_id"), F.col("ts"),
        text_of("h", (F.col("user_id") % 20).cast("string")).alias("host"),
        F.col("event_type").alias("program"),
        text_of(F.col("event_type"), " k=", k, " from 10.0.0.", (F.col("user_id") % 8).cast("string")).alias("message"))


def counters(spark: SparkSession, folder: str, bits: int = 32) -> DataFrame:
    """One counter per (user, type): the running total of the values, wrapped at ``2 ** bits``; 32 bits with large steps, so that some wrap.

    Every fifth switch says that its counters have 16 bits, a width whose wrap is not known.
    """
    from opsloom.plans.hotkeys import running_sum

    ev = table(spark, folder, "events").select(
        F.col("user_id").alias("switch"), F.col("event_type").alias("port"), "ts", "event_id",
        F.floor("value").cast("long").alias("step"), F.col("ts").cast("date").alias("day"))
    run = running_sum(ev, ["switch", "port"], "day", ["ts", "event_id"], F.col("step"), "total")
    return run.select(
        "switch", "port", F.col("ts").alias("t"), F.col("event_id").alias("sample"), "day",
        (F.col("total") * (65537 if bits == 32 else 1) % (1 << bits)).cast("decimal(20,0)").alias("rx_ok"),
        (F.col("total") * (3 * 65537 if bits == 32 else 3) % (1 << bits)).cast("decimal(20,0)").alias("tx_ok"),
        (F.col("total") % 7).cast("decimal(20,0)").alias("rx_err"),
        (F.col("total") % 5).cast("decimal(20,0)").alias("tx_err"),
        (F.col("step") % 11 != 0).alias("admin"), (F.col("step") % 4 != 0).alias("link"),
        F.when(F.col("switch") % 5 == 0, 16).otherwise(bits).alias("bits"))


def probes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as health probes: an error is no answer, anything else an HTTP code."""
    ev = table(spark, folder, "events")
    code = (F.when(F.col("event_type") == "error", "000").when(F.col("event_type") == "signup", "503")
            .when(F.col("event_type") == "click", "401").otherwise("200"))
    return ev.select(
        "event_id", F.col("ts"), text_of("http://svc", (F.col("user_id") % 10).cast("string")).alias("url"),
        code.alias("http_code"), (F.col("value") / 1000).alias("seconds"),
        (F.col("user_id") % 2 == 0).alias("own_proxy"))


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Region, nation, supplier as one adjacency list."""
    region = table(spark, folder, "region").select(
        text_of("R", F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"),
        F.lit(None).cast("string").alias("parent_id"))
    nation = table(spark, folder, "nation").select(
        text_of("N", F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"),
        text_of("R", F.col("n_regionkey").cast("string")).alias("parent_id"))
    supplier = table(spark, folder, "supplier").select(
        text_of("S", F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"),
        text_of("N", F.col("s_nationkey").cast("string")).alias("parent_id"))
    return region.unionByName(nation).unionByName(supplier)


# bank wordings given to orders in turn; {n} is the customer number
WORDINGS = [
    "STARBUCKS STORE 0{n} COLUMBUS OH", "AMZN MKTP US*2K4L91", "AMAZON PRIME*{n} SEATTLE WA",
    "PURCHASE AUTHORIZED ON 01/05 SQ *BLUE BOTTLE COFFEE 123456 SAN FRANCISCO CA", "TST* BLUE DOOR CAFE",
    "KROGER #{n} COLUMBUS OH", "DEBIT CARD PURCHASE XXXX1234 JOE'S HARDWARE 555-123-4567", "POS DEBIT LOCAL PIZZA SHOP",
    "ACME CORP PAYROLL DIRECT DEP", "DUKE ENERGY PAYMENT", "TRANSFER TO SAVINGS", "RENT PAYMENT OAK APARTMENTS",
    "BRIGHTSPEED 833-692-7773 NC BRIGHTSPEED XXX-XXX-7773 NC", "#{n}", "ACH CREDIT REF A1B2C3D4E{n} MIDTOWN BAKERY TX",
    "Corner shop Corner shop", "RECURRING PAYMENT AUTHORIZED ON 02/03 GYM {n} CO ID:55", "",
]
LABELS = ["Kids:Allowance", "Food & Dining:Groceries", "Income:Paycheck", "Savings", "Auto:Gas : Premium", "Uncategorized", "", "Hobby"]


def pick(index: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def bank_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as raw bank lines: wording by order number, sign by status, label of another ledger app."""
    o = table(spark, folder, "orders")
    n = F.col("o_custkey").cast("string")
    raw = pick(F.col("o_orderkey") % len(WORDINGS), WORDINGS)
    return o.select(
        text_of("O", F.col("o_orderkey").cast("string")).alias("id"), F.col("o_orderkey").alias("line_no"),
        text_of("u", (F.col("o_custkey") % 10).cast("string")).alias("user_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.replace(raw, F.lit("{n}"), n).alias("description"),
        (cents(F.col("o_totalprice")) * F.when(F.col("o_orderstatus") == "O", 1).otherwise(-1)).alias("amount_cents"),
        pick(F.col("o_custkey") % len(LABELS), LABELS).alias("source_label"),
        F.when(F.col("o_custkey") % 5 == 0, "credit_card").otherwise("checking").alias("account_type"))


def user_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Two rules for every second user number the customers map to."""
    users = table(spark, folder, "customer").select((F.col("c_custkey") % 10).alias("u")).distinct().filter("u % 2 = 0")
    both = users.select(text_of("u", F.col("u").cast("string")).alias("user_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return both.select(
        "user_id", text_of("r", F.col("k").cast("string")).alias("rule_id"),
        F.when(F.col("k") == 0, "merchant_exact").otherwise("contains").alias("match_type"),
        F.when(F.col("k") == 0, "Starbucks").otherwise("columbus").alias("pattern"),
        F.when(F.col("k") == 0, "Dining & Coffee").otherwise("Travel").alias("category"),
        (F.lit("2026-01-01").cast("timestamp") + F.make_interval(days=F.when(F.col("user_id") == "u4", 5).otherwise(1) * F.col("k"))).alias("created_at"))


PLANS = ["Streaming", "Housing", "Groceries", "Gym", "Shopping", "Utilities"]


def subscriptions(spark: SparkSession, folder: str) -> DataFrame:
    """A dated series of charges per customer: cadence, count, price pattern and category by customer number."""
    c = table(spark, folder, "customer").select("c_custkey")
    k = F.col("c_custkey")
    series = c.select(k, F.explode(F.sequence(F.lit(0).cast("long"), 1 + k % 8)).alias("i"))
    step = (F.when(k % 7 == 0, 7).when(k % 7 == 1, 14).when(k % 7 == 3, 91).when(k % 7 == 4, 365).when(k % 7 == 5, 9).otherwise(30))
    start = F.date_add(F.lit("2020-01-15").cast("date"), (k % 40).cast("int"))
    date = (F.when(k % 7 == 2, F.add_months(start, F.col("i").cast("int")))
            .when(k % 7 == 6, F.add_months(start, F.floor(F.col("i") / 2).cast("int")))
            .otherwise(F.date_add(start, (F.col("i") * step + F.when(k % 11 == 0, F.col("i") * F.col("i") * 3).otherwise(0)).cast("int"))))
    base = 500 + k % 3000
    cents = (F.when(k % 7 == 6, F.when(F.col("i") % 2 == 0, base).otherwise(base * 4))
             .when(k % 5 == 0, base + F.col("i") * 100).when(k % 5 == 1, base + (F.col("i") % 3) * F.floor(base / 12)).otherwise(base))
    return series.select(
        text_of("C", k.cast("string"), "-", F.col("i").cast("string")).alias("id"), date.alias("date"),
        text_of("m", k.cast("string")).alias("merchant"),
        F.when(k % 13 == 0, cents).otherwise(-cents).cast("long").alias("amount_cents"),
        F.when(k % 13 == 0, "income").otherwise("expense").alias("direction"),
        pick(k % 6, PLANS).alias("category_id"), F.lit("acct-1").alias("account_id"))


def plan_categories(spark: SparkSession) -> DataFrame:
    return spark.sql("""SELECT * FROM VALUES ('Streaming', 'Streaming', 'Subscriptions', false), ('Housing', 'Housing', 'Housing', true),
        ('Groceries', 'Groceries', 'Groceries', true), ('Gym', 'Gym', 'Personal Care', false), ('Shopping', 'Shopping', 'Shopping', false),
        ('Utilities', 'Utilities', 'Utilities', true) AS t(id, name, group, essential)""")


ASKED = [
    "How much did I spend on dining in March?", "What are my subscriptions?", "Any unusual spending last month?",
    "What's my savings rate this year?", "Compare April 2024 vs the month before", "Top merchants last 3 months",
    "How much did I pay Brand#7 in 2000?", "How long to pay off my debt?", "How can I save money?", "Give me a summary",
    "may I see what I got paid last year", "total for brand#12 during 1999", "what's the weather", "rent cost for 2001",
]


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns, each led by one of the standing questions."""
    c = table(spark, folder, "conversations").filter(F.col("role") == "user")
    n = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(n.alias("question_id"), text_of(pick(F.pmod(n, F.lit(len(ASKED))), ASKED), " / ", F.col("text")).alias("question"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", text_of(F.col("source"), "/", F.col("lang"), "/", (F.col("doc_id") % 97).cast("string")).alias("path"), "text")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "conversations")
    n = F.col("conv_id").cast("string")
    return c.select(
        "conv_id", "turn", text_of("User Token", n, " <u", n, "@mail.example.com>").alias("author"),
        text_of(F.col("role"), " <", F.col("role"), "@mail5.example.com>").alias("committer"), F.col("text").alias("message"))


def filters(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as mail filters: a sparse property map with empties, "false" values and contradictions."""
    k = F.col("p_partkey")
    on = lambda cond, v: F.when(cond, v).otherwise("")
    pairs = [
        ("from", on(k % 7 != 0, F.col("p_brand"))), ("to", on(k % 5 == 0, "false")), ("subject", on(k % 3 == 0, F.col("p_name"))),
        ("hasTheWord", on(k % 50 == 0, F.repeat(F.lit("word "), 320))), ("size", on(k % 11 == 0, "10")),
        ("sizeOperator", on(k % 22 == 0, "s_sl")), ("sizeUnit", F.lit("s_smb")),
        ("label", on(k % 4 != 0, F.when(k % 9 == 0, "Infra/Alerts").when(k % 9 == 1, "Infra").otherwise(F.col("p_type")))),
        ("shouldTrash", on(k % 6 == 0, "true")), ("shouldNeverSpam", on(k % 12 == 0, "true")),
        ("shouldStar", F.lit("false")), ("shouldAlwaysMarkAsImportant", on(k % 13 == 0, "true")),
        ("shouldNeverMarkAsImportant", on(k % 26 == 0, "true")), ("someFutureAction", on(k % 17 == 0, "x")),
    ]
    return table(spark, folder, "part").select(
        text_of("f", k.cast("string")).alias("id"), (k + 1).alias("pos"),
        F.map_from_arrays(F.array(*[F.lit(n) for n, _ in pairs]), F.array(*[v for _, v in pairs])).alias("props"))


# shelving styles given to parts in turn; {t} the name, {s} the series, {n} a volume number
TITLE_FORMS = [
    "{n} - {t} (Unabridged)", "{t} ({s}, Book {n})", "{s} #{n}: {t}", "{t}; {s} Series, Book {n}", "{s} {n} - {t}", "The {t}",
    "Unknown Album (4/6/2009 11:31:23 AM)", "{s}: {t}", "{t}, The [B0{i}]", "{s} {n}: A LitRPG Adventure", "Track {n}", "{t} mp3 cd 2 - ",
    "{s} {n}: {t}", "Ámbar_{t} É", "{t}: A {s} Novel",
]


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as shelved book titles with series, volume and a language name."""
    k = F.col("p_partkey")
    raw = pick(k % len(TITLE_FORMS), TITLE_FORMS)
    for mark, value in (("{t}", F.initcap("p_name")), ("{s}", F.initcap("p_type")), ("{n}", (k % 20).cast("string")),
                        ("{i}", F.lpad(k.cast("string"), 8, "0"))):
        raw = F.replace(raw, F.lit(mark), value)
    return table(spark, folder, "part").select(
        k.alias("k"), raw.alias("raw"), F.initcap("p_type").alias("series"), (k % 20).cast("int").alias("n"), F.col("p_brand").alias("author"),
        pick(k % 5, ["English", " german", "de", "x", "Klingon"]).alias("language"))


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("p_partkey")
    mark = F.md5((k % 400).cast("string"))
    title = text_of(F.col("p_name"), " of ", F.lower("p_type"), " ", F.substring(mark, 1, 9), " ", F.substring(mark, 10, 8), F.when(k % 7 == 0, text_of(": ", F.col("p_name"), " again")).otherwise(""))
    return spread(table(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_type")).select(
        k.alias("cat_id"), text_of("Lib/", F.col("p_brand"), "/", title, " vol ", k.cast("string")).alias("path"), title.alias("title"),
        text_of("Writer ", (k % 40).cast("string"), " ", F.col("p_brand")).alias("author"),
        F.when(k % 4 == 0, text_of("B0", F.lpad(k.cast("string"), 8, "0"))).otherwise("").alias("product_id"),
        text_of("Reader ", (k % 3).cast("string")).alias("narrator"))


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Each part once more as a library item with a corrupted path and title."""
    c = catalog(spark, folder)
    k = F.col("cat_id")
    path = (F.when(k % 5 == 1, F.upper("path")).when(k % 5 == 2, F.concat("path", F.lit("x"))).when(k % 5 == 3, text_of("inbox/", k.cast("string"))).otherwise(""))
    title = F.when(k % 3 == 0, F.initcap("title")).when(k % 3 == 1, F.concat("title", F.lit(" (Unabridged)"))).otherwise(F.replace("title", F.lit(" of "), F.lit(" off ")))
    return c.select(text_of("i", k.cast("string")).alias("id"), path.alias("path"), title.alias("title"),
                    F.when(k % 6 != 0, F.col("author")).otherwise("").alias("author"), "product_id", F.when(k % 2 == 0, F.col("narrator")).alias("narrator"))


FILE_FORMS = [
    "{s} Book {v}.m4b", "Chapter {v}.mp3", "0{v} - One Title.mp3", "03-{v} x.mp3", "The Tale Part {v}.mp3", "The Book 0{v}.mp3",
    "{s} {v} Name{v}.m4b", "misc{v}.mp3", "{s} - {v} Fugitive {v}.mp3",
]


def audio_files(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as audio files: one folder per order, a naming style per folder, some in disc folders."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    style = F.col("l_orderkey") % len(FILE_FORMS)
    name = F.replace(F.replace(pick(style, FILE_FORMS), F.lit("{v}"), F.col("l_linenumber").cast("string")), F.lit("{s}"), F.lit("Saga"))
    disc = F.when((F.col("l_orderkey") % 8 == 0) & (F.col("l_linenumber") % 2 == 0), "CD 2/").otherwise("")
    tag = F.when(F.col("l_orderkey") % 10 == 3, text_of("Album ", (F.col("l_linenumber") % 2).cast("string"), " (Unabridged)"))
    return li.select(
        text_of("lib/o", F.col("l_orderkey").cast("string"), "/", disc, name).alias("path"), tag.alias("album"),
        text_of("o", F.col("l_orderkey").cast("string")).alias("book"), F.when(F.col("l_orderkey") % 8 == 0, (F.col("l_linenumber") % 2 + 1).cast("string")).alias("disc"),
        F.when(F.col("l_partkey") % 9 != 0, text_of(F.col("l_linenumber").cast("string"), "/7")).alias("track"))


def games(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as game records with nested lists and links."""
    k = F.col("p_partkey")
    none = F.lit(None)
    link = lambda n, u: F.struct(F.lit(n).alias("name"), u.alias("url"))
    url = text_of("https://x/", k.cast("string"))
    return table(spark, folder, "part").select(
        k.alias("id"), F.col("p_name").alias("name"), pick(k % 4, ["Steam", "GOG", "", "Epic"]).alias("store"), k.cast("string").alias("game_id"),
        F.when(k % 5 != 0, k * 977 % 100000).alias("playtime_sec"), F.when(k % 3 != 0, F.date_add(F.lit("2020-01-01").cast("date"), (k % 2000).cast("int"))).alias("last_played"),
        F.lit("2019-05-05").cast("date").alias("added"), F.when(k % 7 != 0, F.date_add(F.lit("1999-01-01").cast("date"), (k % 9000).cast("int"))).alias("released"),
        (k % 2 == 0).alias("installed"), (k % 10 == 0).alias("hidden"), (k % 11 == 0).alias("favorite"),
        F.when(k % 6 == 0, (k % 101).cast("int")).alias("user_score"), F.when(k % 4 == 0, (k * 3 % 101).cast("int")).alias("community_score"),
        F.when(k % 9 == 0, (k * 7 % 101).cast("int")).alias("critic_score"),
        F.array(F.lit("RPG"), F.col("p_type")).alias("genres"),
        F.when(k % 8 != 0, F.array(pick(k % 5, ["Single Player", "Multi-player", "Online Co-Op", "PvP", "Versus"]), F.lit("Cloud Saves"))).alias("features"),
        F.array().cast("array<string>").alias("tags"), F.array(F.col("p_brand")).alias("developers"), none.cast("array<string>").alias("publishers"),
        F.array(F.lit("PC")).alias("platforms"),
        F.when(k % 3 == 0, F.array(link("Wiki", url), link("Official Store", F.when(k % 2 == 0, url).otherwise("")), link("GOG page", F.concat(url, F.lit("/gog"))))).alias("links"))


MONEY_FORMS = ["${a}.{c}", "({a}.{c})", "-{a}.{c}", "{a}.{c}-", "{a}.{c} DR", "{a}.{c} CR", "USD {a}.{c}", "abc", "", "+{a}.{c}", "1.{a},{c}"]


def statement_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as lines of 40 statement files in four styles, each with a header line and a total line."""
    o = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    style = k % 4
    n = cents(F.col("o_totalprice"))
    whole, part = (n - n % 100) / 100, F.lpad((n % 100).cast("string"), 2, "0")
    w = whole.cast("long").cast("string")
    grouped = F.format_number(whole.cast("long"), 0)
    rows = o.select(
        text_of("f", (k % 40).cast("string"), ".csv").alias("file"), (F.floor(k / 40) + 2).alias("line_no"),
        F.when(style == 0, F.concat(F.date_format("o_orderdate", "MM/dd/yyyy"), F.lit(",\"Order, "), k.cast("string"), F.lit("\","),
                                    F.when(F.col("o_orderstatus") == "F", F.concat(w, F.lit("."), part, F.lit(","))).otherwise(F.concat(F.lit(","), w, F.lit("."), part))))
        .when(style == 1, F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(";Kauf "), k.cast("string"), F.lit(";"), F.replace(grouped, F.lit(","), F.lit(".")), F.lit(","), part, F.lit(";ref")))
        .when(style == 2, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("|"), F.when(F.col("o_orderstatus") == "P", "purchase").otherwise("credit"), F.lit("|$"), grouped, F.lit("."), part, F.lit("| pay "), k.cast("string"), F.lit(" ")))
        .otherwise(F.concat(F.date_format("o_orderdate", "MMM d, yyyy"), F.lit("\t"), w, F.lit("."), part, F.lit("\tnote for order "), k.cast("string"))).alias("line"))
    files = rows.select("file").distinct().withColumn("s", F.regexp_extract("file", r"\d+", 0).cast("int") % 4)
    heads = files.filter("s < 3").select("file", F.lit(1).cast("long").alias("line_no"), pick(F.col("s"), [
        "Trans. Date,Description,Debit,Credit", "Posted;Date;Payee;Amount;Memo", "Date|Type|Amount|Details"]).alias("line"))
    heads = heads.withColumn("line", F.when(F.col("line").startswith("Posted"), "Date;Payee;Amount;Memo").otherwise(F.col("line")))
    totals = files.select("file", F.lit(1_000_000_000).cast("long").alias("line_no"), F.lit("Total,,,").alias("line"))
    return rows.unionByName(heads).unionByName(totals)
