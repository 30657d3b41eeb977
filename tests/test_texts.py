"""Alerting, metrics, corpus, rule sets, catalogue and statement cases."""
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from opsloom.functions import titles as X
from opsloom.functions.patterns import alternatives, occurs, required_text
from opsloom.functions.rules import BRANDS, BUILTIN_RULES, SOURCE_GROUPS
from opsloom.operators import alerts as S
from opsloom.operators import catalog as B
from opsloom.operators import title_pairs
from opsloom.operators import corpus as K
from opsloom.operators import library as G
from opsloom.operators import metrics as M
from opsloom.operators import questions as N
from opsloom.operators import rulesets as R
from opsloom.plans import hotkeys as H
from opsloom.sources import filters_xml as FX
from opsloom.sources import statements as I
from opsloom.sources import tables

T0 = dt.datetime(2026, 1, 1)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def events(spark, seconds, message="Failed password from 10.0.0.5 a", host="h1"):
    rows = [(i, T0 + dt.timedelta(seconds=s), host, "sshd", message) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, host string, program string, message string")


def test_substring_first_patterns(spark):
    rng = random.Random(1)
    words = [w for p, *_ in BUILTIN_RULES for w in re.findall(r"[A-Z]{3,}", p)]
    texts = [" ".join(rng.choice(words) for _ in range(3)) + rng.choice(["", "S", " 1"]) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    for p, *_ in rng.sample(BUILTIN_RULES, 8) + rng.sample(BRANDS, 8):
        assert "|".join(alternatives(p)) == p
        assert df.filter(occurs(F.col("t"), p) != F.col("t").rlike(p)).count() == 0
    low = df.select(F.lower("t").alias("t"))
    for p, _ in rng.sample(SOURCE_GROUPS, 8):
        assert low.filter(occurs(F.col("t"), p, True) != F.col("t").rlike("(?i)" + p)).count() == 0
    assert required_text(r"E-?PAYMENT") == ("PAYMENT", False)


def test_signature_and_line(spark):
    parsed = S.parse_log(spark.createDataFrame([("2026|h1|sshd|Failed password a|b",), ("x|y",)], "value string")).collect()
    assert parsed[0].message == "Failed password a|b" and parsed[1].program == ""
    rule = S.Rule("LOGIN", ("Failed password",), recipients=("ops",), dedup_key=r"from\s+(\d+\.\d+\.\d+\.\d+)")
    row = S.signed(events(spark, [0]), [rule]).first()
    assert row.signature == "LOGIN:h1:10.0.0.5"


def test_suppression_windows(spark):
    rules = [S.Rule("A", ("Failed",), dedup_window_s=3600)]
    m = S.signed(events(spark, [*range(0, 4201, 600), 5101, 6001]), rules)
    sent = sorted((r.sent_at - int(T0.replace(tzinfo=dt.timezone.utc).timestamp()), r.suppressed) for r in S.suppress(m, rules).collect())
    assert sent == [(0, 0), (3600, 5), (5101, 0)]
    assert S.episodes(m).count() == 2


def test_suppression_equals_a_plain_walk(spark):
    rng = random.Random(2)
    seconds = sorted(rng.randrange(0, 400_000) for _ in range(600))
    rules = [S.Rule("A", ("Failed",), dedup_window_s=1500)]
    last_seen = last_sent = None
    want, held = [], 0
    for s in seconds:
        if last_seen is None or s - last_seen > 900:
            last_sent, held = None, 0
        if last_sent is None or s - last_sent >= 1500:
            want.append((s, held))
            last_sent, held = s, 0
        else:
            held += 1
        last_seen = s
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = sorted((r.sent_at - base, r.suppressed) for r in S.suppress(S.signed(events(spark, seconds), rules), rules).collect())
    assert got == want


def test_activation_labels(spark):
    m = events(spark, [*range(0, 4201, 600), 5101, 6001])
    stated = S.state_events(m, [S.Rule("A", ("Failed",))])
    base = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = {r.sec - base: r.label for r in S.notify_on_activation(stated, 3600).collect()}
    assert got[0] == "NOTIFIED" and got[3600] == "SILENT" and {got[s] for s in (600, 3000, 4200, 5101, 6001)} == {"SUPPRESSED"}


def test_durations_and_order(spark):
    rows = spark.createDataFrame([("90s",), ("30m",), (" 4H ",), ("7d",), ("15",), ("soon",)], "d string").select(S.duration_column(F.col("d")).alias("s")).collect()
    assert [r.s for r in rows] == [90, 1800, 14400, 604800, 15, None]
    assert [r.name for r in S.reorder([S.Rule("A", ("a",)), S.Rule("B", ("b",))], ["B"])] == ["B", "A"]


def test_hot_key_helpers_equal_plain_windows(spark):
    from pyspark.sql import Window
    rng = random.Random(4)
    df = spark.createDataFrame([("a" if rng.random() < 0.7 else "b", i, rng.randrange(5000), rng.randrange(9)) for i in range(800)], "k string, i long, s long, v long")
    df = df.withColumn("b", F.floor(F.col("s") / 500))
    w = Window.partitionBy("k").orderBy("s", "i")
    plain = df.withColumn("p", F.lag("v").over(w)).withColumn("r", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = H.running_sum(H.lag_over(df, ["k"], "b", ["s", "i"], {"p": F.col("v")}), ["k"], "b", ["s", "i"], F.col("v"), "r")
    key = lambda d: sorted((r.i, r.p, r.r) for r in d.collect())
    assert key(plain) == key(got)
    recent = {r.i: r.c for r in H.recent_counts(df, ["k"], "s", 300, "c").collect()}
    want = {r.i: r.c for r in df.withColumn("c", F.count("*").over(Window.partitionBy("k").orderBy("s").rangeBetween(-300, -1))).collect()}
    assert recent == want
    value = H.value_at_rank(df, "s", F.floor(F.col("n") * F.lit(0.95)), 100).first()
    assert value.value == sorted(r.s for r in df.collect())[int(800 * 0.95)]


def test_recent_counts_read_no_frame_twice(spark):
    from pyspark.sql import Window
    rng = random.Random(8)
    df = spark.createDataFrame([(rng.choice(["a", "a", "b", None]), i, rng.choice([None, -700, 0, 100, 200, 299, 300, 301, 600, rng.randrange(-900, 3000)])) for i in range(700)], "k string, i long, s long")
    got = H.recent_counts(df, ["k"], "s", 100, "c")
    want = df.filter("s IS NOT NULL").withColumn("c", F.count("*").over(Window.partitionBy("k").orderBy("s").rangeBetween(-100, -1)))
    counts = {r.i: r.c for r in got.collect()}
    assert len(counts) == 700 and {i: c for i, c in counts.items() if c is not None} == {r.i: r.c for r in want.collect()}
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", got._jdf.queryExecution().optimizedPlan().toString())
    assert frames and all("unboundedpreceding" in f for f in frames)


def test_counters(spark):
    d = lambda new, old, bits: one(spark, M.delta(F.lit(new).cast(M.COUNTER), F.lit(old).cast(M.COUNTER), F.lit(bits)))
    assert d(5, 2 ** 32 - 5, 32) == 10 and d(1, 9, 33) is None and d("3", str(2 ** 64 - 1), 64) == 4
    assert one(spark, M.short_speed(F.lit("100MbpsHalfDuplex"))) == "100M HDX"
    raw = spark.createDataFrame([("1/0/Up/1/1000MbpsFullDuplex/1518|3/0/Down/1//1518|,1/10/2/3/4/5/6/7/8|3/0/0/0/0/0/0/0/0|,",)], "raw string")
    p = {r.port: r for r in M.parse_port_stats(raw).collect()}
    assert p[1].link == "Up" and p[1].rx_err == 2 and p[1].rx_pause == 8 and p[3].link == "Down"
    assert [one(spark, M.level(F.lit(v), 80, 90)) for v in (79, 80, 95)] == ["ok", "warn", "crit"]


def test_corpus_rules(spark):
    assert [r.kind for r in K.compile_rules(["# c", "", "sk-x", "glob:sk-*xyz", "regex:a+==>b"])] == ["literal", "glob", "regex"]
    assert re.search(K.glob_pattern("sk-*xyz"), "key sk-123xyz!")
    with pytest.raises(ValueError):
        K.compile_rules(["regex:==>x"])
    rules = K.compile_rules(["Jane Doe==>$1 X"])
    docs = spark.createDataFrame([(1, "a.txt", "by Jane Doe"), (2, "b.txt", "by jane doe"), (3, "c.txt", "none"), (4, "z.txt", "by Jane Doe")], "doc_id long, path string, text string")
    said = spark.createDataFrame([("Jane Doe <j@x>", "bot", "fix for Jane Doe")], "author string, committer string, message string")
    r = K.scan(docs, said, rules).first()
    assert (r.blobs, r.near_misses, r.messages, r.idents) == (1, 1, 1, 1)
    clean = K.redact(docs, rules)
    assert clean.filter("doc_id = 1").first().text == "by $1 X"
    assert K.verify_clean(clean, K.redact(said, rules, "message"), rules).first().clean


def test_filter_feed_round_trip(spark, tmp_path):
    props = [("f1", 1, {"from": "a'b", "label": "Infra/Alerts", "shouldArchive": "true", "to": "", "shouldStar": "false"}), ("f2", 2, {"hasTheWord": "x & y", "cannedResponse": "keep-me"})]
    df = spark.createDataFrame(props, "id string, pos long, props map<string,string>")
    FX.write_filters(df, str(tmp_path / "out"))
    back = {tuple(sorted(r.props.items())) for r in FX.read_filters(spark, str(tmp_path / "out")).collect()}
    assert back == {(("from", "a'b"), ("label", "Infra/Alerts"), ("shouldArchive", "true")), (("cannedResponse", "keep-me"), ("hasTheWord", "x & y"))}
    bad = spark.createDataFrame([("f3", 3, {"to": "x", "sizeOperator": "s", "sizeUnit": "u"}), ("f4", 4, {"from": "x", "someFutureAction": "1"})], "id string, pos long, props map<string,string>")
    assert {r.id: r.problems for r in R.import_problems(bad).collect()} == {"f3": ["no action"], "f4": []}
    (tmp_path / "wrong.xml").write_text("<other><entry/></other>")
    with pytest.raises(ValueError):
        FX.read_filters(spark, str(tmp_path / "wrong.xml"))


def feed(*entries, head="<?xml version='1.0' encoding='UTF-8'?>\n"):
    return (head + "<feed xmlns='http://www.w3.org/2005/Atom' xmlns:apps='http://schemas.google.com/apps/2006'>\n<title>x</title>" + "\n".join(entries) + "\n</feed>\n")


def entry(*props):
    return "<entry>\n <title>Mail Filter</title>\n " + "".join(f"<apps:property name='{k}' value='{v}'/>" for k, v in props) + "\n</entry>"


def test_feeds_are_read_in_splits(spark, tmp_path):
    many = [entry(("from", f"a{i}@b &amp; c"), ("subject", "é" * (i % 40)), ("from", "late" if i % 5 == 0 else f"a{i}@b &amp; c")) for i in range(3000)]
    (tmp_path / "many.xml").write_text(feed(*many), encoding="utf-8")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        pieces = FX._pieces(spark, str(tmp_path / "many.xml"))
        assert pieces.rdd.getNumPartitions() > 10
        rows = FX.read_filters(spark, str(tmp_path / "many.xml")).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.props["from"] for r in rows] == [f"a{i}@b & c" for i in range(3000)]
    assert [r.clashes for r in rows] == [["from"] if i % 5 == 0 else [] for i in range(3000)]
    assert all(r.props.get("subject") == "é" * (i % 40) for i, r in enumerate(rows))
    assert len({r.id for r in rows}) == 3000


def test_unusual_feeds(spark, tmp_path):
    def read(text):
        folder = tmp_path / str(len(list(tmp_path.iterdir())))
        folder.mkdir()
        (folder / "f.xml").write_text(text)
        return [r.props for r in FX.read_filters(spark, str(folder)).orderBy("pos").collect()]

    a, b = entry(("from", "a")), entry(("from", "b"))
    assert read(feed(a, "<entry/>", b, "<entry />")) == [{"from": "a"}, {}, {"from": "b"}, {}]
    assert read(feed(a.replace("</entry>", "</entry\n>"), b)) == [{"from": "a"}, {"from": "b"}]
    assert read(feed(a, "<!-- " + b + " -->", b.replace("Mail Filter", "<![CDATA[</entry>]]>"))) == [{"from": "a"}, {"from": "b"}]
    assert read(feed(a, b, head="\n<!-- made by hand -->\n")) == [{"from": "a"}, {"from": "b"}]
    assert read(feed()) == [] and read("") == []
    with pytest.raises(ValueError):
        read("<other>" + feed(a) + "</other>")


def test_titles(spark):
    assert round(one(spark, X.title_score(F.lit("foundation and earth"), F.lit("foundation"))), 1) == 78.3
    assert one(spark, X.match_score(F.lit("The Last Hope"), F.lit(None), F.lit("Warriors: Omen of the Stars #6: The Last Hope"), F.lit(None))) == 100.0
    assert one(spark, X.find_product_id(F.lit("Foundation [B005T6ZETM]"))) == "B005T6ZETM"
    assert tuple(one(spark, X.split_series(F.lit("The Gunslinger (Dark Tower, Book 1)")))) == ("The Gunslinger", "Dark Tower", 1)
    assert one(spark, X.without_junk(F.lit("Unknown Album (4/6/2009 11:31:23 AM)"))) is None
    for raw, want in {"Jatouche; Pyreans Series, Book 03": "Jatouche", "The Silver Ships: The Silver Ships, Book 1": "The Silver Ships", "Libre: A Silver Ships Novel": "Libre"}.items():
        assert one(spark, X.strip_title_suffix(F.lit(raw))) == want
    assert one(spark, X.strip_series_prefix(F.lit("Foundation 01 - Prelude to Foundation"), F.lit("Foundation"))) == "Prelude to Foundation"
    assert one(spark, X.strip_series_prefix(F.lit("Foundation and Empire"), F.lit("Foundation"))) == "Foundation and Empire"


def test_walks_of_long_keys_are_composed_of_blocks(spark):
    rng = random.Random(5)
    rows, want = [], []
    for key, gap, share in (("a", 3600, 0.01), ("b", 100, 0.2), ("c", 86400, 0.002), ("d", 7, 0.3), ("e", 40_000, 0.0001), ("f", 3600, 0.00001)):
        span = 30_000 if share > 0.1 else 40 * 86400 if share < 0.005 else 5 * 86400
        first = rng.randrange(10 ** 9)
        seconds = sorted({first + rng.randrange(span) for _ in range(max(1, int(span * share)))})
        if key in "bd":  # short stretches on both sides of midnight, days apart
            seconds = sorted({86400 * k + s % 30_000 - 15_000 for s in seconds for k in (20, 21, 29)})
        last, held = None, 0
        for s in seconds:
            n = rng.randrange(1, 4)
            rows.append((key, s, n, gap))
            if last is None or s >= last + gap:
                want.append((key, s, held))
                last, held = s, n - 1
            else:
                held += n
    per = spark.createDataFrame(rows, "key string, sec long, n long, gap long").repartition(4)
    for most in (0, 1000, 100_000):
        got = S.spaced_seconds(per, ["key"], F.col("gap"), most).collect()
        assert sorted((r.key, r.sec, r.passed) for r in got) == sorted(want) and len(want) > 200


def test_near_keys_are_complete(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(30, 60))).strip() + "z" for _ in range(60)]

    def edit(s):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1:], s[:i] + "x" + s[i:], s[:i] + "y" + s[i + 1:]])
        return s
    left = spark.createDataFrame([(edit(b),) for b in base], "key string")
    right = spark.createDataFrame([(b,) for b in base], "key string")
    want = {(r.a, r.b) for r in left.select(F.col("key").alias("a")).distinct().join(right.select(F.col("key").alias("b")), F.lit(True)).filter(
        X.sequence_ratio(F.col("a"), F.col("b")) >= 97).collect()}
    assert {(r.lkey, r.rkey) for r in B.near_keys(left, right).collect()} == want and len(want) > 10


def test_title_pairs_are_complete(spark):
    rng = random.Random(11)
    words = ["mist", "born", "hope", "of", "the", "stars", "foundation", "empire"]
    base = ["mistborn", "foundation", "hope", "last hope of the stars"] + [" ".join(rng.choices(words, k=rng.randrange(1, 5))) for _ in range(40)]

    def edit(s):
        for _ in range(rng.randrange(1, 5)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1:] or s, s[:i] + "x" + s[i:], s[:i] + " " + s[i:]])
        return " ".join(s.split()) or "x"
    names = ["", "ann lee", "lee ann", "bob stone", "b stone", "reader 1", "reader 2"]

    def rows(keys):
        return [(k, rng.choice(names), rng.choice(names)) for k in keys]
    left = spark.createDataFrame(rows(["mistbron", "foundaton", "", "long " * 20 + "tail", *map(edit, base)]), "key string, a_key string, n_key string").distinct()
    right = spark.createDataFrame(rows(["long " * 20 + "tale", *base, *base]), "rkey string, ca_key string, cn_key string").distinct()
    title = X.title_score(F.col("key"), F.col("rkey"))
    score = X.with_author(title, F.col("a_key"), F.col("ca_key"))
    score = F.when(X.token_set_ratio(F.col("n_key"), F.col("cn_key")) > 85, F.least(F.lit(100.0), score + 5.0)).otherwise(score)
    scored = left.crossJoin(right).filter("key <> ''").withColumn("s", score).collect()
    for least in (60.0, 82.0, 90.0):
        got = {(*r[:6], r.score) for r in title_pairs.scored_pairs(left, right, least, rows=(20, 30)).select("key", "a_key", "n_key", "rkey", "ca_key", "cn_key", "score").collect()}
        assert got == {tuple(r) for r in scored if r.s >= least} and len(got) > 40
    items = spark.createDataFrame([("i1", "", "Mistbron", "", ""), ("i2", "", "Foundaton", "", "")], "id string, path string, title string, author string, product_id string")
    entries = spark.createDataFrame([(1, "", "Mistborn", "", ""), (2, "", "Foundation", "", "")], "cat_id long, path string, title string, author string, product_id string")
    assert {(r.id, r.cat_id) for r in B.top_candidates(items, entries).collect()} == {("i1", 1), ("i2", 2)}
    assert {(r.id, r.cat_id, r.how) for r in B.link_catalog(items, entries).collect()} == {("i2", 2, "title")}


def test_near_paths_measure_no_more_edits_than_allowed(spark):
    keys = spark.createDataFrame([(f"lib brand {i % 3} red bolt of promo volume {i:04d}",) for i in range(60)], "key string")
    plan = B.near_keys(keys, keys)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"levenshtein\(lkey#\d+, rkey#\d+, Some\(k#\d+\)|levenshtein\(lkey#\d+, rkey#\d+, k#\d+", plan)


def test_best_pairs_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    words = ["mist", "born", "hope", "of", "the", "stars", "foundation", "empire", "a", "very long " * 7 + "word"]
    names = ["", "ann lee", "bob stone", "b stone", "reader 1"]

    def row():
        return " ".join(rng.choices(words, k=rng.randrange(1, 6))), rng.choice(names), rng.choice(names)
    left = [*{row() for _ in range(60)}]
    right = [(*e, [i, 1000 + i // 3]) for i, e in enumerate({row() for _ in range(150)})]
    hints, entries = spark.createDataFrame(left, "key string, a_key string, n_key string"), spark.createDataFrame(right, "rkey string, ca_key string, cn_key string, ids array<long>")
    cols = ["key", "a_key", "n_key", "rkey", "ca_key", "cn_key", "score"]
    every = {tuple(r[:6]): r.score for r in title_pairs.scored_pairs(hints, entries, 60.0).select(cols).collect()}
    assert title_pairs.scored_pairs(hints, entries.limit(0), 60.0, best=3).count() == 0
    ids = {e[:3]: e[3] for e in right}
    for rows in ((20, 40), (2048, 131072)):
        near = {tuple(r[:6]): r.score for r in title_pairs.scored_pairs(hints, entries, 60.0, rows, margin=0.5).select(cols).collect()}
        best = {tuple(r[:6]): r.score for r in title_pairs.scored_pairs(hints, entries, 60.0, rows, best=3).select(cols).collect()}
        assert near.items() <= every.items() and best.items() <= every.items() and len(near) < len(best) < len(every)
        for h in left:
            own = sorted(((s, p) for p, s in every.items() if p[:3] == h), reverse=True)
            assert all(p in near for s, p in own if s >= own[0][0] - 0.5)
            assert all(p in best or len({i for t, q in own if t > s for i in ids[q[3:]]}) >= 3 for s, p in own)


def test_library_sort_gives_every_game_its_position(spark):
    folder = "/root/testdata/sf0.01"
    games = tables.games(spark, folder)
    rated = [(r.id, r.s) for r in games.select("id", G.score().alias("s")).collect()]
    want = {i: n for n, (i, _) in enumerate(sorted(rated, key=lambda r: (r[1] is None, -(r[1] or 0), r[0])), 1)}
    rows = entry.queries()["library_sort"](spark, folder).collect()
    assert {r.id: r.position for r in rows} == want and len(rows) == len(rated) > 300


def test_plan_works_out_a_destination_once_per_branch(spark):
    rows = [(1, "a/x", "T", "Ann", 100.0, "", ""), (2, "a/y", "t", "ANN", 100.0, "", ""), (3, "a/z", "", "Ann", 100.0, "", ""), (4, "a/u", "U", "Ann", 90.0, "", ""),
            (5, "Ann/V", "V", "Ann", 100.0, "", ""), (6, "a/w", "W", "Ann", None, None, "Saga"), (7, None, "?", "Bob", 100.0, "B0", None)]
    books = spark.createDataFrame(rows, "id int, path string, title string, author string, match_score double, product_id string, series string").withColumn("series_index", F.lit("7"))
    planned = B.plan(B.plan_layout(books.withColumn("title", F.regexp_replace("title", "#", ""))))
    assert planned.columns == [*books.columns, "destination", "bucket"]
    assert {r.id: (r.destination, r.bucket) for r in planned.collect()} == {
        1: ("Ann/T", "conflict"), 2: ("ANN/t", "conflict"), 3: (None, "undetermined"), 4: ("Ann/U", "held"), 5: ("Ann/V", "in_place"),
        6: ("Ann/Saga/Book 07 - W", "move"), 7: ("Bob/Unknown", "move")}
    tree = planned.select("id", "bucket")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [line for line in tree if re.search(r"(Filter|Join) .*(regexp|transform)", line)]


def test_book_from_its_path(spark):
    want = {"lib/t": ("lib", None, "t", None), "Ann/Saga/02 - Foo (Dark Tower, Book 4)": ("Ann", "Dark Tower", "Foo", "4"), "Ann/Saga/03 - Bar": ("Ann", "Saga", "Bar", "3"),
            "Saga/Saga/03 - Bar": ("Saga", None, "Bar", None), "/Ann//Baz mp3/": ("Ann", None, "Baz", None), "Ann/mp3/4 - x": ("Ann", "", "x", None), "": (None, None, "", None), "/": (None, None, "", None),
            None: (None, None, None, None)}
    paths = spark.createDataFrame([(p,) for p in want], "path string")
    assert {r.path: tuple(r.m) for r in paths.select("path", B.infer_from_path(F.col("path")).alias("m")).collect()} == want


@pytest.mark.parametrize("names,groups", [
    (["01 - One.mp3", "02 - One.mp3"], 1), (["Series Book 1.mp3", "Series Book 2.mp3"], 2), (["The Tale 01.mp3", "The Tale 02.mp3", "The Tale 03.mp3"], 1), (["The Book 01.mp3", "The Book 02.mp3"], 2),
    (["S - 6 Fugitive.mp3", "S - 7 Collapse.mp3"], 2), (["Tale Part 1.mp3", "Tale Part 2.mp3"], 1), (["S 8.m4b", "S 9.m4b", "S 11.m4b"], 3), (["Chapter 1.mp3", "Chapter 2.mp3"], 1),
])
def test_files_into_books(spark, names, groups):
    files = spark.createDataFrame([("lib/x/" + n, None) for n in names], "path string, album string")
    assert B.group_files(files).select("folder", "book").distinct().count() == groups


def test_money_and_statement(spark):
    for text, comma, want in [("$1,234.56", False, 123456), ("(12.34)", False, -1234), ("12.34-", False, -1234), ("12.34 DR", False, -1234), ("12.34 CR", False, 1234),
                              ("1.234,56", True, 123456), ("abc", False, None), ("", False, None), ("1" * 41, False, None)]:
        assert one(spark, I.parse_money(F.lit(text), comma)) == want
    lines = ["Statement period 12/15/2025 - 01/14/2026", "12/23 DOORDASH*THAI GARDEN 42.18", "01/02 SPOTIFY USA 11.99", "01/05 PAYMENT THANK YOU 200.00"]
    df = spark.createDataFrame([("d", i + 1, x) for i, x in enumerate(lines)], "doc_id string, line_no long, line string")
    rows = [(r.date, r.amount_cents) for r in I.parse_statement_lines(df, True).orderBy("line_no").collect()]
    assert rows == [(dt.date(2025, 12, 23), -4218), (dt.date(2026, 1, 2), -1199), (dt.date(2026, 1, 5), 20000)]


def test_read_lines_numbers_whole_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Description,Amount\n01/02/2026,X,-1.00\n,,\n")
    lines = I.read_lines(spark, str(tmp_path / "a.csv"))
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == [1, 2, 3]
    assert I.split_grid(lines).count() == 2


def test_grounding(spark):
    assert one(spark, N.grounded(F.lit("You spent $1,250.50 (12%)."), F.lit("total 1250.50, share 12.00")))
    assert not one(spark, N.grounded(F.lit("about $1,300"), F.lit("total 1250.50")))


def test_scan_passes_over_binary_items(spark):
    rules = K.compile_rules(["secret"])
    docs = spark.createDataFrame([(1, "a", "a secret"), (2, "b", "a secret\x00"), (3, "c", "x" * 9000 + "\x00 secret"), (4, "d", None)], "doc_id long, path string, text string")
    assert sorted(r.path for r in K.scan_items(docs, rules).filter(F.size("hits") > 0).collect()) == ["a", "c"]


def test_plan_keeps_books_without_a_destination(spark):
    rows = [("a", None, 100.0, ""), ("b", None, 100.0, ""), ("c", "x/One", 100.0, ""), ("d", "X/one", 100.0, ""), ("e", "e", 100.0, ""), ("f", "y", 50.0, ""), ("g", "z", 100.0, "B0"), ("h", "h/i", 100.0, "")]
    books = spark.createDataFrame(rows, "path string, destination string, match_score double, product_id string")
    got = {r.path: r.bucket for r in B.plan(books).collect()}
    assert got == {"a": "undetermined", "b": "undetermined", "c": "conflict", "d": "conflict", "e": "in_place", "f": "held", "g": "move", "h": "undetermined"}


def test_spend_answers_equal_brute_force(spark):
    import random
    rng = random.Random(3)
    day = lambda: dt.date(1969, 6, 1) + dt.timedelta(days=rng.randrange(1400))
    rows = [(rng.choice([day(), day(), None]), rng.choice(["a", "b", None]), rng.choice(["x", "y", None]), rng.randrange(-900, 200), rng.choice(["expense", "expense", "income"])) for _ in range(300)]
    asks = [(i, rng.choice(["a", "b", "zz", None]), rng.choice(["x", "y", None]), s, s + dt.timedelta(days=rng.choice([-1, 0, 1, 6, 30, 90, 400, 1200]))) for i in range(120) for s in [day()]]
    asks += [(500, "a", None, None, None), (501, "a", None, dt.date(1900, 1, 1), dt.date(2100, 1, 1)), (502, "a", "x", dt.date(1800, 1, 1), dt.date(1800, 2, 1))]
    ledger = spark.createDataFrame(rows, "date date, merchant string, category_id string, amount_cents long, direction string")
    questions = spark.createDataFrame(asks, "question_id long, merchant string, category_id string, period_start date, period_end date")
    got = {r.question_id: r for r in N.spend_answers(questions, ledger).collect()}
    assert len(got) == len(asks)
    for i, merchant, category, start, end in asks:
        inside = [r for r in rows if start and r[0] and start <= r[0] <= end]
        hit = [r for r in inside if r[4] == "expense" and (r[1] == merchant if merchant else bool(category) and r[2] == category)]
        r = got[i]
        assert (r.total_cents, r["count"], r.refund_cents, r.has_data) == (-sum(h[3] for h in hit), len(hit), sum(h[3] for h in hit if h[3] > 0), bool(inside))
        assert r.largest_cents == (-min(h[3] for h in hit) if hit else None)


@pytest.mark.parametrize("block", [64, 10 ** 6])
def test_records_across_line_breaks_in_every_encoding(spark, tmp_path, block):
    import csv
    import io
    rows = [["1", "plain", "x"], ["2", "two\nlines; and ""quoted"" words", "y"], ["3", "caf\u00e9 \u20ac", "z"], ["4", "a\n\nb\nc", "w"], ["5", '5" pipe', "v"]] * 9
    wide = [["1", "\u0a00\u0100\u010a\u0a0a \u4e0a\u0a4e", "x"], ["2", "in\n\u0a0a\n\u0100", "y"]] * 9

    def write(name, rows, encoding, end="\n", mark=b""):
        out = io.StringIO()
        csv.writer(out, delimiter=";", lineterminator=end).writerows(rows)
        (tmp_path / name).write_bytes(mark + out.getvalue().encode(encoding))
    want = {"u8.csv": ("UTF-8", rows), "bom.csv": ("UTF-8", rows), "cp.csv": ("cp1252", rows), "le.csv": ("UTF-16LE", rows + wide), "be.csv": ("UTF-16BE", rows + wide)}
    write("u8.csv", rows, "utf-8")
    write("bom.csv", rows, "utf-8", "\r\n", b"\xef\xbb\xbf")
    write("cp.csv", rows, "cp1252")
    write("le.csv", rows + wide, "utf-16-le", "\r\n", b"\xff\xfe")
    write("be.csv", rows + wide, "utf-16-be", "\n", b"\xfe\xff")
    (tmp_path / "odd.csv").write_bytes(b'1;"open;x\n2;b;y\n3;c;z\n')
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        lines = I.read_encoded_lines(spark, str(tmp_path))
        told = {r.file.rsplit("/", 1)[1]: r.encoding for r in lines.select("file", "encoding").distinct().collect()}
        got = {}
        for r in I.split_grid(I.join_quoted_lines(lines)).orderBy("line_no").collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append(list(r.cells))
        joined = [r.line for r in I.join_quoted_lines(lines).filter("file LIKE '%odd.csv'").orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    for name, (encoding, cells) in want.items():
        assert told[name] == encoding and got[name] == cells, name
    assert joined == ['1;"open;x', "2;b;y", "3;c;z"]


def test_line_hunks_lead_from_old_to_new(spark):
    from opsloom.functions import linediff as D
    rng = random.Random(11)
    pairs = [(0, None, "a"), (1, "a", None), (2, "", "a\nb"), (3, "x\ny", "x\ny"), (4, "a\na\na", "a\na"), (5, "- a\n+ b", "+ b\n- a")]
    for i in range(6, 80):
        old = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14))]
        new = [x for x in old if rng.random() > 0.2] + [rng.choice("abxyz") for _ in range(rng.randrange(3))]
        rng.shuffle(new) if i % 9 == 0 else None
        pairs.append((i, "\n".join(old), "\n".join(new)))
    df = spark.createDataFrame(pairs, "k int, o string, n string").withColumn("h", D.line_hunks(F.col("o"), F.col("n"), 1))
    for r in df.withColumn("again", D.apply_hunks(F.col("o"), F.col("h"))).collect():
        assert r.again == r.n, r
        old = r.o.split("\n") if r.o is not None else []
        for h in r.h:
            was = [x[1:] for x in h.lines if x[0] in " -"]
            assert old[h.old_start - 1:h.old_start - 1 + len(was)] == was and any(x[0] != " " for x in h.lines)
    # lines all different: as few changes as the longest common subsequence allows
    old, new = [str(i) for i in range(300)], [str(i) for i in range(300) if i % 7] + ["end"]
    new[10:10] = ["in"]
    assert sum(a1 - a0 + b1 - b0 for a0, a1, b0, b1 in D.changed_runs(old, new)) == 43 + 2
    assert D.hunks_of(["a", "b", "c", "d"], ["a", "B", "c", "d"], 1) == [(1, 1, [" a", "-b", "+B", " c"])]
