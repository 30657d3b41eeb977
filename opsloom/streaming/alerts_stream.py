"""Streaming twins of the log alerting operators.

Event time takes the place of the clock. The watermark is the grace period plus the lateness allowed; what comes
later is dropped by Spark. The one keyed state is a few numbers per signature, with a time to live.
"""
from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opsloom.operators import alerts as S
from opsloom.operators.alerts import Rule

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# fixed value: days the archive keeps
KEEP_DAYS = 90
NOTES = "signature string, kind string, at bigint, count bigint, message string"
STATE = "first_seen bigint, last_seen bigint, last_sent bigint, held bigint, escalated boolean, message string, after bigint"


def read_log_stream(spark: SparkSession, path: str, lateness: str = "20 minutes", files_per_trigger: int = 1000) -> DataFrame:
    """Bar-separated log lines of a growing folder as events with a watermark."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    parsed = S.parse_log(lines).withColumn("ts", F.try_to_timestamp("ts")).filter(F.col("ts").isNotNull())
    return parsed.withWatermark("ts", lateness)


def matched_stream(events: DataFrame, rules: Sequence[Rule], mode: str = "first") -> DataFrame:
    """Coarse filter, rules and signature: stateless, one projection before the shuffle by signature."""
    return S.signed(S.coarse_filter(events, rules), rules, mode).withColumn(
        "window_s", S.per_rule(rules, lambda r: F.lit(r.dedup_window_s))).withColumn(
        "escalate_s", S.per_rule(rules, lambda r: F.lit(r.escalation_after_s if r.escalation_group else None).cast("int")))


class SuppressProcessor(StatefulProcessor):
    """Per signature: episode, last send, held-back count; an event-time timer raises the escalation."""

    def __init__(self, grace_s: int = S.GRACE_S, keep_s: int = S.PRUNE_S) -> None:
        self.grace_s, self.keep_ms = grace_s, keep_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # state time to live works on the processing clock; event-time runs end state by timer instead
        self.state = handle.getValueState("alert", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = last = sent = after = known = None
        held, escalated, message = 0, False, ""
        if self.state.exists():
            first, last, sent, held, escalated, message, after = self.state.get()
            known = last
        out = []
        batch = pd.concat(list(rows), ignore_index=True).sort_values("sec", kind="stable")
        for sec, text, window, escalate in batch[["sec", "message", "window_s", "escalate_s"]].itertuples(index=False, name=None):
            sec, message = int(sec), text
            if last is None or sec - last > self.grace_s:
                if after is not None and not escalated:
                    self.handle.deleteTimer((first + after) * 1000)
                first, sent, held, escalated = sec, None, 0, False
                after = None if pd.isna(escalate) else int(escalate)
                if after is not None:
                    self.handle.registerTimer((sec + after) * 1000)
            last = sec if last is None else max(last, sec)
            if sent is None or sec - sent >= int(window):
                out.append((key[0], "send", sec, held, text))
                sent, held = sec, 0
            else:
                held += 1
        self.state.update((first, last, sent, held, escalated, message, after))
        if known is not None:
            self.handle.deleteTimer(known * 1000 + self.keep_ms)
        self.handle.registerTimer(last * 1000 + self.keep_ms)
        if out:
            yield pd.DataFrame(out, columns=["signature", "kind", "at", "count", "message"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        at = expiredTimerInfo.getExpiryTimeInMs() // 1000
        first, last, sent, held, escalated, message, after = self.state.get()
        if at >= last + self.keep_ms // 1000:
            self.state.clear()
        elif not escalated and at - last <= self.grace_s and after is not None and at >= first + after:
            self.state.update((first, last, sent, held, True, message, after))
            yield pd.DataFrame([(key[0], "escalate", at, held, message)], columns=["signature", "kind", "at", "count", "message"])

    def close(self) -> None:
        pass


def suppress_stream(matched: DataFrame, rules: Sequence[Rule], grace_s: int = S.GRACE_S) -> DataFrame:
    """Notifications of a matched stream: ``send`` rows with the occurrences held back before them, ``escalate`` rows.

    Digest rules never send. Only seconds, message and the rule's two durations reach the keyed state.
    """
    live = matched.filter(F.col("rule_ord").isin([i for i, r in enumerate(rules) if not r.digest]))
    return live.select("signature", "ts", "sec", "message", "window_s", "escalate_s").groupBy("signature").transformWithStateInPandas(
        SuppressProcessor(grace_s), outputStructType=NOTES, outputMode="Append", timeMode="EventTime")


def digest_stream(matched: DataFrame, rules: Sequence[Rule], interval_s: int = S.DIGEST_S) -> DataFrame:
    """Digest counts per interval, group and alert, emitted when the watermark passes the interval.

    Two windowed aggregations, one on the other: first one state row per interval, group, alert and host, so that a
    host counts once however often it speaks, then their sums.
    """
    flagged = matched.filter(F.col("rule_ord").isin([i for i, r in enumerate(rules) if r.digest])).withColumn("grp", S.first_group(rules))
    per_host = flagged.groupBy(F.window("ts", f"{interval_s} seconds").alias("w"), "grp", "alert", "host").agg(
        F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return per_host.groupBy(F.window("w", f"{interval_s} seconds").alias("slot"), "grp", "alert").agg(
        F.sum("n").alias("events"), F.count("host").alias("hosts"), F.min("first").alias("first_ts"), F.max("last").alias("last_ts")).select(
        F.unix_seconds("slot.start").alias("window_start"), "grp", "alert", "events", "hosts", "first_ts", "last_ts")


def episode_stream(matched: DataFrame, grace_s: int = S.GRACE_S) -> DataFrame:
    """Closed episodes per signature from session windows; a gap of exactly ``grace_s`` stays in the session."""
    return matched.groupBy(F.session_window("ts", f"{grace_s} seconds").alias("w"), "signature").agg(
        F.min("sec").alias("first_seen"), F.max("sec").alias("last_seen"), F.count("*").alias("count")).select(
        "signature", "first_seen", "last_seen", "count")


def write_archive(events: DataFrame, path: str, checkpoint: str):
    """Raw events as compressed parquet by year, month, day, host, hour and batch; starts the query.

    Lines of a host-hour are brought together before they are written: one file for each host-hour and batch, more
    only where Spark splits a host-hour that is too large for a task. The batch number is the last partition and
    replaces what an interrupted attempt at the same batch left; days go with ``drop_old_days``.
    """
    ts = F.col("ts")
    rows = events.withColumns({"y": F.year(ts), "m": F.month(ts), "d": F.dayofmonth(ts), "h": F.hour(ts)})

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # streams run without adaptive execution; here it may split and merge what the hint brought together
        session.conf.set("spark.sql.adaptive.enabled", "true")
        together = session.sql("SELECT /*+ REBALANCE(y, m, d, host, h) */ * FROM {rows}", rows=batch)
        together.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option(
            "compression", "zstd").partitionBy("y", "m", "d", "host", "h", "batch").parquet(path)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_old_days(spark: SparkSession, path: str, keep_days: int = KEEP_DAYS, today: dt.date | None = None) -> list[dt.date]:
    """Delete the archive's days more than ``keep_days`` before ``today`` (the newest day, if not given) and return them.

    Whole day folders go; no file is read. What the driver lists is one name for each day.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "y=*/m=*/d=*")) or []
    days = {}
    for status in found:
        year, month, day = (int(part.split("=")[1]) for part in status.getPath().toString().rsplit("/", 3)[1:])
        days[dt.date(year, month, day)] = status.getPath()
    if not days:
        return []
    last = (today or max(days)) - dt.timedelta(days=keep_days)
    old = sorted(d for d in days if d < last)
    for d in old:
        files.delete(days[d], True)
    return old


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into parquet and stop."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
    query.awaitTermination()
