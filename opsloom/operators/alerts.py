"""Log alerting on batch tables: parsing, rule matching, episodes, suppression, escalation, digests, state.

Rules are plain Python data in evaluation order (people write them, so they are few and travel in the plan);
events are ``ts, host, program, message`` plus an id for ties. Event time takes the place of the clock.
"""
from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.patterns import occurs
from opsloom.session import cut_lineage
from opsloom.plans.hotkeys import running_sum, sessions_over

GRACE_S = 900
WINDOW_S = 3600
DIGEST_S = 3600
PRUNE_S = 604_800
STALE_MINUTES = 120


@dataclass(frozen=True)
class Rule:
    """One alert rule. ``patterns`` are alternatives; the optional gates look at program and host."""
    name: str
    patterns: tuple[str, ...]
    severity: str = "info"
    program: str | None = None
    program_exclude: str | None = None
    host: str | None = None
    host_exclude: str | None = None
    recipients: tuple[str, ...] = ()
    dedup_window_s: int = WINDOW_S
    dedup_key: str | None = None
    digest: bool = False
    stop: bool = False
    escalation_after_s: int | None = None
    escalation_group: str | None = None
    relays: tuple[str, ...] | None = None
    recovery: tuple[str, ...] = ()
    subject: str = "[{{severity}}] {{alert}} on {{host}}"




def duration_column(text: Column) -> Column:
    t = F.lower(F.trim(text))
    unit = F.regexp_extract(t, r"^(\d+)\s*([smhd]?)$", 2)
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.when(t.rlike(r"^\d+\s*[smhd]?$"), F.regexp_extract(t, r"^(\d+)", 1).cast("long") * factor)


# --- lines -----------------------------------------------------------------------------------------------------

def parse_log(lines: DataFrame, strict: bool = False) -> DataFrame:
    """``value`` -> ts, host, program, message: cut at the first three bars, missing fields empty.

    ``strict`` also adds ``bad`` for lines without four fields, so they can go to a side table.
    """
    parts = F.split("value", r"\|", 4)
    field_at = lambda i: F.coalesce(F.try_element_at(F.col("__p"), F.lit(i)), F.lit(""))
    out = lines.filter(F.trim("value") != "").withColumn("__p", parts)
    fields = [field_at(i + 1).alias(n) for i, n in enumerate(("ts", "host", "program", "message"))]
    rest = [c for c in lines.columns if c != "value"]
    if strict:
        return out.select(*rest, *fields, (F.size("__p") != 4).alias("bad"))
    return out.select(*rest, *fields)


def coarse_filter(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Keep events that any rule's pattern can match; cheap and placed before the per-rule test."""
    text = F.lower("message")
    return events.filter(reduce(lambda a, b: a | b, [_any_pattern(text, r.patterns, True) for r in rules]))


def _valid(patterns: Sequence[str]) -> list[str]:
    out = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error:
            continue
        out.append(p)
    return out


def _any_pattern(text: Column, patterns: Sequence[str], ignore_case: bool) -> Column:
    usable = _valid(patterns)
    return reduce(lambda a, b: a | b, [occurs(text, p, ignore_case) for p in usable], F.lit(False))


# --- matching ----------------------------------------------------------------------------------------------------

def _gate(rule: Rule) -> Column:
    out = F.lit(True)
    for column, wanted, banned in (("program", rule.program, rule.program_exclude), ("host", rule.host, rule.host_exclude)):
        text = F.coalesce(F.col(column), F.lit(""))
        if wanted:
            out = out & text.rlike("(?i)" + wanted)
        if banned:
            out = out & ~text.rlike("(?i)" + banned)
    return out


def rule_hits(rules: Sequence[Rule], ignore_case: bool = True) -> Column:
    """Array of the ordinals of all rules that fit, in rule order."""
    text = F.col("__low") if ignore_case else F.col("message")
    return F.array_compact(F.array(*[
        F.when(_gate(r) & _any_pattern(text, r.patterns, ignore_case), F.lit(i)) for i, r in enumerate(rules)]))


def match_rules(events: DataFrame, rules: Sequence[Rule], mode: str = "first", ignore_case: bool = True) -> DataFrame:
    """One row per event and matching rule, with rule_ord and alert.

    ``first`` keeps the earliest rule; ``all`` keeps every rule up to and including the first with ``stop``.
    """
    out = events.withColumn("__low", F.lower("message")).withColumn("__hits", rule_hits(rules, ignore_case)).filter(F.size("__hits") > 0)
    if mode == "first":
        out = out.withColumn("rule_ord", F.col("__hits")[0])
    else:
        stops = [i for i, r in enumerate(rules) if r.stop]
        cut = F.try_element_at(F.filter("__hits", lambda h: h.isin(stops)), F.lit(1)) if stops else F.lit(None).cast("int")
        kept = F.filter("__hits", lambda h: F.coalesce(h <= cut, F.lit(True)))
        out = out.withColumn("rule_ord", F.explode(kept))
    return with_rule(out.drop("__low", "__hits"), rules)


def per_rule(rules: Sequence[Rule], value) -> Column:
    """Column with ``value(rule)`` of the row's rule."""
    return F.element_at(F.array(*[value(r) for r in rules]), F.col("rule_ord") + 1)


def with_rule(matched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return matched.withColumn("alert", per_rule(rules, lambda r: F.lit(r.name)))


def signature(rules: Sequence[Rule]) -> Column:
    """``alert:host``, plus what the rule's key pattern captures in the message (group 1 if it has one)."""
    def suffix(i: int, r: Rule) -> Column:
        group = 1 if re.compile(r.dedup_key).groups else 0
        return F.when((F.col("rule_ord") == i) & F.col("message").rlike(r.dedup_key),
                      F.concat(F.lit(":"), F.regexp_extract("message", r.dedup_key, group)))
    extra = [suffix(i, r) for i, r in enumerate(rules) if r.dedup_key]
    return F.concat(F.col("alert"), F.lit(":"), F.col("host"), F.coalesce(*extra, F.lit("")))


def signature_sha(host: Column, alert: Column, message: Column | None = None) -> Column:
    base = F.concat(host, F.lit(":"), alert)
    if message is not None:
        base = F.when(F.coalesce(message, F.lit("")) != "", F.concat(base, F.lit(":"), message)).otherwise(base)
    return F.sha2(base, 256)


def signed(events: DataFrame, rules: Sequence[Rule], mode: str = "first") -> DataFrame:
    """Matched events with signature and whole seconds since the epoch."""
    return match_rules(events, rules, mode).withColumn("signature", signature(rules)).withColumn(
        "sec", F.unix_seconds(F.col("ts").cast("timestamp")))


# --- episodes and suppression -------------------------------------------------------------------------------------

def _per_second(matched: DataFrame) -> DataFrame:
    """Occurrences per signature and second: the most any later step sees of a hot signature."""
    return matched.groupBy("signature", "sec").agg(F.count("*").alias("n")).withColumn("__day", F.floor(F.col("sec") / 86400))


def episode_seconds(matched: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    """(signature, sec, n, episode): a new episode starts after a gap of more than ``grace_s`` seconds."""
    return sessions_over(_per_second(matched), ["signature"], "__day", "sec", grace_s, "episode").drop("__day")


def episodes(matched: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    return episode_seconds(matched, grace_s).groupBy("signature", "episode").agg(
        F.min("sec").alias("first_seen"), F.max("sec").alias("last_seen"), F.sum("n").alias("count"))


def _walk(keys: list[str]):
    """Batches sorted by keys and second -> the stops; a batch and the walk's last stop are all that is held."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, last, held = None, None, 0
        for pdf in batches:
            sec, gap, sums = pdf["sec"].to_numpy(), pdf["__gap"].to_numpy(), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
            starts = np.flatnonzero((pdf[keys] != pdf[keys].shift()).any(axis=1).to_numpy())
            at, passed = [], []
            for start, end in zip(starts, [*starts[1:], len(pdf)]):
                key = tuple(pdf[k].iat[start] for k in keys)
                if key != current:
                    current, last, held = key, None, 0
                while start < end:
                    stop = start if last is None else start + int(np.searchsorted(sec[start:end], last + gap[start]))
                    held += int(sums[stop] - sums[start])
                    if stop < end:
                        at.append(stop)
                        passed.append(held)
                        last, held = int(sec[stop]), int(sums[stop + 1] - sums[stop]) - 1
                    start = stop + 1
            if at:
                yield pdf[[*keys, "sec"]].iloc[at].assign(passed=passed)
    return run


#: Blocks of the walk: so many seconds, or so many times the gap if that is longer.
BLOCK_S, BLOCK_GAPS = 86400, 16
_MAP = "secs array<bigint>, stops array<bigint>, tails array<bigint>, total bigint, gap bigint"


def _block_map(keys: list[str]):
    """For a block of seconds: from every second at which the walk may enter it to its last stop there and the events after that.

    A walk is ready again one gap after its last stop at most, so it enters in the first gap of the block, or at the first second behind that.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sec")
        sec, gap, sums = pdf["sec"].to_numpy(), int(pdf["__gap"].iat[0]), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        after = np.searchsorted(sec, sec + max(gap, 1))
        last = np.where(after < len(sec), after, np.arange(len(sec)))
        while not np.array_equal(last[last], last):
            last = last[last]
        enter = min(len(sec), int(np.searchsorted(sec, pdf["__start"].iat[0] + gap)) + 1)
        ends = last[:enter]
        return pdf[[*keys, "__block"]].iloc[:1].assign(secs=[sec[:enter]], stops=[sec[ends]], tails=[sums[-1] - sums[ends] - 1], total=int(sums[-1]), gap=gap)
    return run


def _compose(keys: list[str]):
    """Maps of a key's blocks in order -> when the walk is ready in each block, and the events it has passed since its last stop."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, ready, held = None, None, 0
        for pdf in batches:
            found = []
            for row in pdf.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, ready, held = key, None, 0
                found.append((ready, held))
                at = 0 if ready is None else int(np.searchsorted(row.secs, ready))
                if at < len(row.secs):
                    ready, held = int(row.stops[at]) + row.gap, int(row.tails[at])
                else:
                    held += row.total
            yield pdf[[*keys, "__block"]].assign(__ready=pd.array([f[0] for f in found], "Int64"), __held=[f[1] for f in found])
    return run


def _walk_block(keys: list[str]):
    """The stops inside one block, from when the walk is ready."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sec")
        sec, gap, sums = pdf["sec"].to_numpy(), int(pdf["__gap"].iat[0]), np.concatenate([[0], np.cumsum(pdf["n"].to_numpy())])
        ready, held, begun = pdf["__ready"].iat[0], int(pdf["__held"].iat[0]), 0
        at, passed = [], []
        stop = 0 if pd.isna(ready) else int(np.searchsorted(sec, int(ready)))
        while stop < len(sec):
            at.append(stop)
            passed.append(held + int(sums[stop] - sums[begun]))
            begun, held = stop + 1, int(sums[stop + 1] - sums[stop]) - 1
            stop = max(stop + 1, int(np.searchsorted(sec, sec[stop] + gap)))
        return pdf[[*keys, "sec"]].iloc[at].assign(passed=np.array(passed, np.int64))
    return run


def spaced_seconds(per: DataFrame, keys: Sequence[str], gap: Column, most: int = 100_000) -> DataFrame:
    """The seconds a greedy walk stops at: the first, then each first one at least ``gap`` after the last stop,
    with the events ``passed`` between two stops.

    ``per`` has one row per key and distinct second with its count ``n``; keys are not null, the gap is one per key. Keys of
    at most ``most`` seconds, about a day's, are walked as a stream. A longer key is walked by blocks (days, or 16 gaps) in parallel: each block
    first says where every possible entry leads, one pass over these maps in order finds the entry of each block, and the
    blocks are then walked from their entries. No task sees more than a block of such a key, or a sixteenth of it.
    """
    keys = list(keys)
    types = dict(per.dtypes)
    names = ", ".join(f"`{k}` {types[k]}" for k in keys)
    size = F.greatest(F.lit(BLOCK_S), F.col("__gap") * BLOCK_GAPS)
    rows = per.select(*keys, "sec", "n", gap.cast("long").alias("__gap")).withColumn("__block", F.floor(F.col("sec") / size)).withColumn("__start", F.col("__block") * size)
    rows = cut_lineage(rows)  # four branches read it, none should match the log again
    spread = rows.groupBy(*keys, "__block").agg(F.count("*").alias("__n"))
    many = spread.groupBy(*keys).agg(F.sum("__n").alias("__n")).filter(F.col("__n") > most).drop("__n")
    long = cut_lineage(spread.drop("__n").join(many, keys, "left_semi"))
    if long.isEmpty():
        long, rest = None, rows
    else:
        rest = rows.join(long, [*keys, "__block"], "left_anti")
    short = rest.repartition(*keys).sortWithinPartitions(*keys, "sec")
    out = short.select(*keys, "sec", "n", "__gap").mapInPandas(_walk(keys), f"{names}, sec bigint, passed bigint")
    if long is None:
        return out
    parts = rows.join(long, [*keys, "__block"], "left_semi")
    maps = parts.groupBy(*keys, "__block").applyInPandas(_block_map(keys), f"{names}, __block bigint, {_MAP}")
    entries = maps.repartition(*keys).sortWithinPartitions(*keys, "__block").mapInPandas(_compose(keys), f"{names}, __block bigint, __ready bigint, __held bigint")
    walked = parts.join(entries, [*keys, "__block"]).groupBy(*keys, "__block").applyInPandas(_walk_block(keys), f"{names}, sec bigint, passed bigint")
    return out.unionByName(walked)


def suppress(matched: DataFrame, rules: Sequence[Rule], grace_s: int = GRACE_S) -> DataFrame:
    """The notifications: signature, episode, sent_at, suppressed (occurrences since the previous one).

    Within an episode the first event is sent, then the next one at least the rule's window after the last
    sent. Digest rules never send.
    """
    live = [i for i, r in enumerate(rules) if not r.digest]
    sendable = matched.filter(F.col("rule_ord").isin(live))
    window = sendable.groupBy("signature").agg(F.min("rule_ord").alias("rule_ord")).withColumn(
        "__w", per_rule(rules, lambda r: F.lit(r.dedup_window_s)).cast("long")).drop("rule_ord")
    per = episode_seconds(sendable, grace_s).join(window, "signature")
    return spaced_seconds(per, ["signature", "episode"], F.col("__w")).select(
        "signature", "episode", F.col("sec").alias("sent_at"), F.col("passed").alias("suppressed"))


def dedup_state(matched: DataFrame, sent: DataFrame, grace_s: int = GRACE_S) -> DataFrame:
    """Latest state per signature: the current episode's span, last send, occurrences since, sample message."""
    spans = episodes(matched, grace_s)
    last = spans.groupBy("signature").agg(F.max_by(F.struct("episode", "first_seen", "last_seen", "count"), "episode").alias("e")).select(
        "signature", "e.*")
    lately = sent.groupBy("signature", "episode").agg(F.max("sent_at").alias("last_sent"))
    sample = matched.groupBy("signature").agg(F.max_by(F.struct("alert", "host", "message"), F.struct("ts", "event_id")).alias("m"))
    out = last.join(lately, ["signature", "episode"], "left").join(sample, "signature")
    since = matched.select("signature", "sec").join(out.select("signature", "first_seen", "last_sent"), "signature")
    open_count = since.filter((F.col("sec") >= F.col("first_seen")) & (F.col("last_sent").isNull() | (F.col("sec") > F.col("last_sent")))).groupBy(
        "signature").agg(F.count("*").alias("pending"))
    return out.join(open_count, "signature", "left").select(
        "signature", F.col("m.alert").alias("alert"), F.col("m.host").alias("host"), "first_seen", "last_seen", "last_sent",
        F.coalesce("pending", F.lit(0)).alias("pending"), F.col("count").alias("episode_count"), F.col("m.message").alias("sample_msg"))


def escalations(state: DataFrame, rules: Sequence[Rule], now_s: int, grace_s: int = GRACE_S) -> DataFrame:
    """Signatures still firing at ``now_s`` whose episode is old enough, with minutes and count."""
    chain = [r for r in rules if r.escalation_after_s and r.escalation_group]
    after = reduce(lambda acc, r: acc.when(F.col("alert") == r.name, F.lit(r.escalation_after_s)), chain, F.when(F.lit(False), F.lit(0)))
    group = reduce(lambda acc, r: acc.when(F.col("alert") == r.name, F.lit(r.escalation_group)), chain, F.when(F.lit(False), F.lit("")))
    age = F.lit(now_s) - F.col("first_seen")
    open_state = state.filter(~F.col("escalated")) if "escalated" in state.columns else state
    return open_state.filter((F.lit(now_s) - F.col("last_seen") <= grace_s) & (age >= after)).select(
        "signature", "alert", "host", group.alias("escalation_group"), F.call_function("div", age.cast("long"), F.lit(60)).alias("minutes"),
        F.col("episode_count").alias("count"))


def first_group(rules: Sequence[Rule]) -> Column:
    return per_rule(rules, lambda r: F.lit(r.recipients[0] if r.recipients else ""))


def digest(matched: DataFrame, rules: Sequence[Rule], interval_s: int = DIGEST_S) -> DataFrame:
    """Digest-flagged events per interval, first recipient group and alert, with host counts."""
    flagged = matched.filter(F.col("rule_ord").isin([i for i, r in enumerate(rules) if r.digest])).withColumn("grp", first_group(rules))
    slot = F.window(F.col("ts").cast("timestamp"), f"{interval_s} seconds")
    return flagged.groupBy(slot.alias("w"), "grp", "alert").agg(
        F.count("*").alias("events"), F.countDistinct("host").alias("hosts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(
        F.unix_seconds("w.start").alias("window_start"), "grp", "alert", "events", "hosts", "first_ts", "last_ts")


def digest_lines(matched: DataFrame, rules: Sequence[Rule], interval_s: int = DIGEST_S) -> DataFrame:
    """The digest's lines themselves, one row each, in group, alert and time order (for a range-sorted write)."""
    flagged = matched.filter(F.col("rule_ord").isin([i for i, r in enumerate(rules) if r.digest]))
    slot = F.unix_seconds(F.window(F.col("ts").cast("timestamp"), f"{interval_s} seconds")["start"])
    return flagged.select(slot.alias("window_start"), first_group(rules).alias("grp"), "alert", "ts", "host", "message")


# fixed values: severity synonyms and scores
SEVERITIES = {"INFO": "INFO", "INFORMATION": "INFO", "WARN": "WARNING", "WARNING": "WARNING", "CRITICAL": "CRITICAL",
              "ERROR": "CRITICAL", "FATAL": "CRITICAL", "DEBUG": "INFO"}
SCORES = {"INFO": 1, "WARNING": 2, "CRITICAL": 3}


def normalize_severity(text: Column) -> Column:
    up = F.upper(text)
    return reduce(lambda acc, kv: acc.when(up == kv[0], kv[1]), SEVERITIES.items(), F.when(F.lit(False), "")).otherwise("INFO")


def severity_score(text: Column) -> Column:
    return reduce(lambda acc, kv: acc.when(text == kv[0], kv[1]), SCORES.items(), F.when(F.lit(False), 0)).otherwise(1)


def severity_digest(alerts: DataFrame, start: Column, end: Column) -> DataFrame:
    """Alerts of the window by (host, alert), worst first; latest = highest severity text, then newest."""
    seen = alerts.filter((F.col("ts") >= start) & (F.col("ts") <= end))
    return seen.groupBy("host", "alert").agg(
        F.count("*").alias("count"), F.max(severity_score(F.col("severity"))).alias("severity_score"),
        F.max_by(F.struct("message", "ts"), F.struct("severity", "ts", "event_id")).alias("l")).select(
        "host", "alert", "count", "severity_score", F.col("l.message").alias("latest_message"), F.col("l.ts").alias("latest_time")).orderBy(
        F.desc("severity_score"), "host", "alert")


# --- activation state -----------------------------------------------------------------------------------------------

def state_events(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Alert and recovery events per signature (host:alert): kind is ACTIVE or RECOVERED."""
    found = match_rules(events, rules, "all").withColumn("kind", F.lit("ACTIVE"))
    cured = events.withColumn("__low", F.lower("message")).withColumn("__hits", F.array_compact(F.array(*[
        F.when(_any_pattern(F.col("__low"), r.recovery, True) if r.recovery else F.lit(False), F.lit(i)) for i, r in enumerate(rules)])))
    cured = with_rule(cured.withColumn("rule_ord", F.explode("__hits")).drop("__low", "__hits"), rules).withColumn("kind", F.lit("RECOVERED"))
    return found.unionByName(cured).withColumn("signature", F.concat("host", F.lit(":"), "alert"))


def latest_state(stated: DataFrame) -> DataFrame:
    return stated.groupBy("signature").agg(
        F.max_by(F.struct(F.col("kind").alias("state"), F.col("ts").alias("last_seen")), F.struct("ts", "event_id", "kind")).alias("s"),
        F.min("ts").alias("first_seen")).select("signature", "s.state", "first_seen", "s.last_seen")


def active_alerts(state: DataFrame) -> DataFrame:
    return state.filter(F.col("state") == "ACTIVE")


def stale_alerts(state: DataFrame, now: Column, minutes: int = STALE_MINUTES) -> DataFrame:
    return active_alerts(state).filter(F.col("last_seen") < now - F.make_dt_interval(mins=F.lit(minutes)))


def notify_on_activation(stated: DataFrame, dedup_s: int) -> DataFrame:
    """Per (signature, second), for the first event of the second: NOTIFIED when the state becomes ACTIVE,
    SUPPRESSED for a repeat less than ``dedup_s`` after the recorded last_seen (which it does not move), SILENT
    for a later repeat (which does). Further events of one second are always suppressed; ``n`` counts them all.
    A recovery ends the active state.
    """
    per = stated.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))).groupBy("signature", "sec").agg(
        F.count_if(F.col("kind") == "ACTIVE").alias("n"), F.max((F.col("kind") == "RECOVERED").cast("int")).alias("cured"))
    per = per.withColumn("__day", F.floor(F.col("sec") / 86400))
    per = running_sum(per, ["signature"], "__day", ["sec"], F.col("cured"), "__done").withColumn("span", F.col("__done") - F.col("cured"))
    busy = per.filter("n > 0").select("signature", "span", "sec", "n")
    moves = spaced_seconds(busy, ["signature", "span"], F.lit(dedup_s)).drop("passed").withColumn("__m", F.lit(True))
    first = busy.groupBy("signature", "span").agg(F.min("sec").alias("__first"))
    marked = busy.join(moves, ["signature", "span", "sec"], "left").join(first, ["signature", "span"])
    label = F.when(F.col("sec") == F.col("__first"), "NOTIFIED").when(F.col("__m"), "SILENT").otherwise("SUPPRESSED")
    return marked.select("signature", "sec", "n", label.alias("label"))


def prune(state: DataFrame, column: Column, now_s: Column, keep_s: int = PRUNE_S) -> DataFrame:
    return state.filter(column >= now_s - keep_s)


# --- recipients, templates, rule reports ------------------------------------------------------------------------------

def recipients(matched: DataFrame, rules: Sequence[Rule], groups: dict[str, Sequence[str]], relay_order: Sequence[str] = ()) -> DataFrame:
    """Add ``to`` (addresses of the rule's groups, first mention kept) and ``relays`` (own chain, else the order)."""
    def addresses(r: Rule) -> Column:
        seen = dict.fromkeys(a for g in r.recipients for a in groups.get(g, ()))
        return F.array(*[F.lit(a) for a in seen]).cast("array<string>")

    def chain(r: Rule) -> Column:
        return F.array(*[F.lit(x) for x in (r.relays or relay_order or ("local-sendmail",))]).cast("array<string>")
    return matched.withColumn("to", per_rule(rules, addresses)).withColumn("relays", per_rule(rules, chain))


def html_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def render(template: str, values: dict[str, Column], escape: bool = False) -> Column:
    """Fill ``{{ name }}`` marks; an unknown name becomes empty. The template is cut once, on the driver."""
    pieces, at = [], 0
    for mark in re.finditer(r"\{\{\s*(\w+)\s*\}\}", template):
        pieces.append(F.lit(template[at:mark.start()]))
        value = F.coalesce(values.get(mark.group(1), F.lit("")).cast("string"), F.lit(""))
        pieces.append(html_escape(value) if escape else value)
        at = mark.end()
    return F.concat(*pieces, F.lit(template[at:]))


def header_safe(text: Column, max_length: int = 998) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[\r\n]+", " ")), 1, max_length)


def subjects(matched: DataFrame, rules: Sequence[Rule], max_length: int = 200) -> DataFrame:
    values = {"alert": F.col("alert"), "host": F.col("host"), "program": F.col("program"), "message": F.col("message"),
              "time": F.col("ts"), "severity": F.col("severity"), "level": F.col("severity")}
    out = matched.withColumn("severity", per_rule(rules, lambda r: F.lit(r.severity)))
    return out.withColumn("subject", header_safe(per_rule(rules, lambda r: render(r.subject, values)), max_length))


def rule_test(samples: DataFrame, rules: Sequence[Rule], mode: str = "all") -> DataFrame:
    """Which rules each sample matches, with the rendered subject; a sample without match keeps one empty row."""
    hit = subjects(match_rules(samples, rules, mode), rules).select("event_id", "alert", "severity", "subject")
    return samples.select("event_id").join(hit, "event_id", "left")


def rule_stats(matched: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Every rule in order with its hits; rules without hits stay, and one that takes everything is marked."""
    spark = matched.sparkSession
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(r.name) for r in rules]))).select(
        F.col("pos").alias("rule_ord"), F.col("col").alias("alert"))
    counts = matched.groupBy("rule_ord").agg(F.count("*").alias("hits"))
    out = listed.join(counts, "rule_ord", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    takes_all = per_rule(rules, lambda r: F.lit(any(re.search(p, "") for p in _valid(r.patterns))))
    return out.withColumn("catch_all", takes_all).withColumn("unused", F.col("hits") == 0)


def reorder(rules: Sequence[Rule], first: Sequence[str]) -> list[Rule]:
    """Listed names to the front in that order, the others after them as they were."""
    by_name = {r.name: r for r in rules}
    unknown = [n for n in first if n not in by_name]
    if unknown:
        raise ValueError("unknown rules: " + ", ".join(unknown))
    return [by_name[n] for n in first] + [r for r in rules if r.name not in set(first)]
