"""Streams over files give what the batch operators give."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from opsloom.operators import alerts as S
from opsloom.operators.alerts import Rule
from opsloom.streaming import alerts_stream as A

RULES = [Rule("A", ("boom",), dedup_window_s=1500, escalation_after_s=600, escalation_group="m"), Rule("D", ("note",), recipients=("ops",), digest=True)]
T0 = dt.datetime(2026, 1, 1)


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(9)
    rows = sorted((rng.randrange(0, 60_000), rng.choice("xy"), rng.choice(["boom", "boom", "note"])) for _ in range(300))
    lines = [f"{(T0 + dt.timedelta(seconds=s)).isoformat()}|h{h}|p|{m}" for s, h, m in rows]
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"part{i}.log").write_text("\n".join(lines[i * 100:(i + 1) * 100]) + "\n")
    # a last line far ahead lets the watermark close what came before
    (tmp_path / "in" / "part9.log").write_text(f"{(T0 + dt.timedelta(days=2)).isoformat()}|hz|p|boom\n")
    return tmp_path


def batch(spark, folder):
    ev = S.parse_log(spark.read.text(str(folder / "in"))).withColumn("ts", F.to_timestamp("ts"))
    return S.signed(ev, RULES)


def test_sends_equal_batch(spark, folder):
    m = A.matched_stream(A.read_log_stream(spark, str(folder / "in")), RULES)
    A.run_available(A.suppress_stream(m, RULES), str(folder / "out"), str(folder / "ck"))
    got = sorted((r.signature, r["at"], r["count"]) for r in spark.read.parquet(str(folder / "out")).filter("kind = 'send'").collect())
    want = sorted((r.signature, r.sent_at, r.suppressed) for r in S.suppress(batch(spark, folder), RULES).collect())
    assert got == want


def test_digest_and_episodes_equal_batch(spark, folder):
    m = A.matched_stream(A.read_log_stream(spark, str(folder / "in")), RULES)
    A.run_available(A.digest_stream(m, RULES), str(folder / "out2"), str(folder / "ck2"))
    key = "window_start", "grp", "alert", "events", "hosts", "first_ts", "last_ts"
    got = {tuple(r) for r in spark.read.parquet(str(folder / "out2")).select(*key).collect()}
    want = {tuple(r) for r in S.digest(batch(spark, folder), RULES).select(*key).collect()}
    # the newest window may stay open until the next trigger
    assert got <= want and len(want - got) <= 1 and {r[4] for r in got} == {1, 2}
    A.run_available(A.episode_stream(m), str(folder / "out3"), str(folder / "ck3"))
    closed = {(r.signature, r.first_seen, r["count"]) for r in spark.read.parquet(str(folder / "out3")).collect()}
    every = {(r.signature, r.first_seen, r["count"]) for r in S.episodes(batch(spark, folder)).collect()}
    assert closed <= every and len(every - closed) <= 1


def test_archive_partitions(spark, folder):
    ev = A.read_log_stream(spark, str(folder / "in"))
    A.write_archive(ev, str(folder / "arc"), str(folder / "ck4")).awaitTermination()
    back = spark.read.parquet(str(folder / "arc"))
    assert back.count() == 301 and {"y", "m", "d", "host", "h"} <= set(back.columns)
    hours = back.select("y", "m", "d", "host", "h", "batch").distinct().count()
    assert len(list((folder / "arc").rglob("*.parquet"))) == hours
    # more lines in a second run are a new batch; nothing written before is replaced
    (folder / "in" / "more.log").write_text(f"{(T0 + dt.timedelta(days=2)).isoformat()}|hz|p|late\n")
    A.write_archive(ev, str(folder / "arc"), str(folder / "ck4")).awaitTermination()
    assert spark.read.parquet(str(folder / "arc")).count() == 302


def test_a_batch_written_again_replaces_itself(spark, folder):
    ev = A.read_log_stream(spark, str(folder / "in"))
    for attempt in range(2):
        A.write_archive(ev, str(folder / "arc"), str(folder / f"ck{attempt}")).awaitTermination()
        assert spark.read.parquet(str(folder / "arc")).count() == 301


def test_old_days_are_dropped(spark, folder):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=n) for n in (0, 1, 30, 90, 91)]
    rows = [(f"{d}T05:00:00|h{i}|p|m\n") for d in days for i in range(2)]
    (folder / "days").mkdir()
    (folder / "days" / "a.log").write_text("".join(rows))
    A.write_archive(A.read_log_stream(spark, str(folder / "days")), str(folder / "arc"), str(folder / "ck")).awaitTermination()
    assert A.drop_old_days(spark, str(folder / "arc")) == [days[0]]
    assert spark.read.parquet(str(folder / "arc")).count() == 8
    assert A.drop_old_days(spark, str(folder / "arc"), today=dt.date(2026, 4, 10)) == days[1:2]
    assert A.drop_old_days(spark, str(folder / "arc"), today=dt.date(2026, 4, 10)) == []
    assert A.drop_old_days(spark, str(folder / "none")) == []


def test_an_ended_episode_does_not_escalate_the_next(spark, tmp_path):
    rules = [Rule("A", ("boom",), escalation_after_s=3600, escalation_group="m")]
    (tmp_path / "in").mkdir()

    def put(name, seconds, host):
        lines = [f"{(T0 + dt.timedelta(seconds=s)).isoformat()}|{host}|p|boom" for s in seconds]
        (tmp_path / "in" / name).write_text("\n".join(lines) + "\n")

    put("a.log", [0, 100, 3500], "early")
    put("b.log", range(0, 4200, 600), "long")
    put("c.log", [86_400], "later")
    m = A.matched_stream(A.read_log_stream(spark, str(tmp_path / "in")), rules)
    A.run_available(A.suppress_stream(m, rules), str(tmp_path / "out"), str(tmp_path / "ck"))
    start = int(T0.replace(tzinfo=dt.timezone.utc).timestamp())
    got = [(r.signature, r["at"] - start) for r in spark.read.parquet(str(tmp_path / "out")).filter("kind = 'escalate'").collect()]
    assert [(s.split(":")[1], at) for s, at in got] == [("long", 3600)]


def test_walk_of_one_busy_key_is_a_stream(spark):
    per = spark.range(2_000_000).select(F.lit("s").alias("signature"), F.col("id").alias("sec"), F.lit(1).cast("long").alias("n"))
    stops = S.spaced_seconds(per, ["signature"], F.lit(1500))
    assert "collect" not in stops._jdf.queryExecution().toString()
    assert tuple(stops.agg(F.count("*"), F.sum("passed"), F.max("sec")).first()) == (1334, 1333 * 1499, 1333 * 1500)
