"""Registered log alerting queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.checks.registry import Registry
from opsloom.checks.views import LOG
from opsloom.operators import alerts as S
from opsloom.operators.alerts import Rule
from opsloom.sources import tables as T

REG = Registry()
HOUR = 3600
GRACE, NOW = 6 * HOUR, 1706745600  # 2024-02-01T00:00:00Z

RULES = [
    Rule("FAULT", ("error k=[0-4]",), "high", host_exclude="^h1$", recipients=("ops", "security"), dedup_key=r"from\s+(\d+\.\d+\.\d+\.\d+)",
         dedup_window_s=12 * HOUR, escalation_after_s=4 * HOUR, escalation_group="management", recovery=("view k=1",)),
    Rule("BUY", ("purchase|BOUGHT", "(bad"), "low", program="^pur", dedup_window_s=8 * HOUR, recipients=("sales",), stop=True,
         subject="[{{severity}}] {{ alert }} on {{host}}: {{message}}"),
    Rule("NINE", ("k=9",), "info", program_exclude="click", recipients=("network",), digest=True, relays=("r2", "r1")),
    Rule("ANY", ("k=",), "warning", dedup_window_s=24 * HOUR, recipients=("ops",), dedup_key="k=[0-9]"),
    Rule("NEVER", ("no such text",), "critical", recipients=("ops",)),
]
GROUPS = {"ops": ["a@x", "b@x"], "security": ["b@x", "c@x"], "sales": ["d@x"], "network": []}

HITS = """
h0 AS (SELECT *, lower(message) AS low FROM v_log),
hits AS (SELECT *, regexp_matches(low,'error k=[0-4]') AND NOT regexp_matches(host,'^h1$') AS r0,
 (contains(low,'purchase') OR contains(low,'bought')) AND regexp_matches(program,'^pur') AS r1,
 contains(low,'k=9') AND NOT contains(program,'click') AS r2, contains(low,'k=') AS r3, false AS r4 FROM h0)
"""
NAMES = ["FAULT", "BUY", "NINE", "ANY", "NEVER"]
NAME = "CASE rule_ord " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(NAMES)) + " END"
SIG = """alert||':'||host||CASE WHEN rule_ord=0 AND regexp_matches(message,'from\\s+(\\d+\\.\\d+\\.\\d+\\.\\d+)') THEN ':'||regexp_extract(message,'from\\s+(\\d+\\.\\d+\\.\\d+\\.\\d+)',1)
 WHEN rule_ord=3 AND regexp_matches(message,'k=[0-9]') THEN ':'||regexp_extract(message,'k=[0-9]') ELSE '' END"""
FIRST = f"""WITH {LOG}, {HITS},
mf AS (SELECT *, {NAME} AS alert FROM (SELECT *, CASE WHEN r0 THEN 0 WHEN r1 THEN 1 WHEN r2 THEN 2 WHEN r3 THEN 3 END AS rule_ord FROM hits) WHERE rule_ord IS NOT NULL),
m AS (SELECT *, {SIG} AS signature, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM mf)"""
ALL = f"""WITH {LOG}, {HITS},
ma AS (SELECT *, {NAME} AS alert FROM (SELECT *, unnest(list_filter([CASE WHEN r0 THEN 0 END, CASE WHEN r1 THEN 1 END, CASE WHEN r2 AND NOT r1 THEN 2 END, CASE WHEN r3 AND NOT r1 THEN 3 END], lambda x: x IS NOT NULL)) AS rule_ord FROM hits))"""


def log(spark, sf):
    return T.log_events(spark, sf)


def matched(spark, sf):
    return S.signed(log(spark, sf), RULES)


@REG.query("parse_log_lines", f"""WITH {LOG}, v AS (SELECT event_id, CASE event_id%5 WHEN 0 THEN host||'|'||program ELSE CAST(epoch_us(ts)//1000 AS VARCHAR)||'|'||host||'|'||program||'|'||message||'|a|b' END AS value FROM v_log),
p AS (SELECT event_id, string_split(value,'|') AS p FROM v)
SELECT event_id, p[1] AS ts, coalesce(p[2],'') AS host, coalesce(p[3],'') AS program, coalesce(array_to_string(p[4:],'|'),'') AS message, len(p)<4 AS bad FROM p""")
def parse_log_lines(spark, sf):
    millis = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    lines = log(spark, sf).select("event_id", F.when(F.col("event_id") % 5 == 0, F.concat_ws("|", "host", "program")).otherwise(
        F.concat(F.concat_ws("|", millis, "host", "program", "message"), F.lit("|a|b"))).alias("value"))
    return S.parse_log(lines, strict=True)


@REG.query("coarse_filter", f"WITH {LOG}, {HITS} SELECT event_id FROM hits WHERE contains(low,'purchase') OR contains(low,'bought') OR regexp_matches(low,'error k=[0-4]') OR contains(low,'k=') OR contains(low,'no such text')")
def coarse_filter(spark, sf):
    return S.coarse_filter(log(spark, sf), RULES).select("event_id")


@REG.query("match_rules_first", f"{FIRST} SELECT event_id, rule_ord, alert FROM m")
def match_rules_first(spark, sf):
    return S.match_rules(log(spark, sf), RULES).select("event_id", "rule_ord", "alert")


@REG.query("match_rules_all", f"{ALL} SELECT event_id, rule_ord, alert FROM ma")
def match_rules_all(spark, sf):
    return S.match_rules(log(spark, sf), RULES, "all").select("event_id", "rule_ord", "alert")


@REG.query("match_any_case_sensitive", f"WITH {LOG} SELECT event_id, CASE WHEN contains(message,'error') THEN 0 ELSE 1 END AS rule_ord FROM v_log WHERE contains(message,'error') OR contains(message,'k=1')")
def match_any_case_sensitive(spark, sf):
    rules = [Rule("A", ("ERROR", "error", "(bad")), Rule("B", ("K=", "k=1"))]
    return S.match_rules(log(spark, sf), rules, ignore_case=False).select("event_id", "rule_ord")


@REG.query("alert_signature", f"{FIRST} SELECT event_id, signature FROM m")
def alert_signature(spark, sf):
    return matched(spark, sf).select("event_id", "signature")


@REG.query("alert_signature_sha", f"{FIRST} SELECT event_id, sha256(host||':'||alert||':'||message) AS signature FROM m")
def alert_signature_sha(spark, sf):
    return S.match_rules(log(spark, sf), RULES).select("event_id", S.signature_sha(F.col("host"), F.col("alert"), F.col("message")).alias("signature"))


EPISODES = f"""{FIRST}, ps AS (SELECT signature, sec, count(*) AS n, min(rule_ord) AS rule_ord FROM m GROUP BY 1,2),
lg AS (SELECT *, CASE WHEN lag(sec) OVER w IS NULL OR sec-lag(sec) OVER w>{GRACE} THEN 1 ELSE 0 END AS nw FROM ps WINDOW w AS (PARTITION BY signature ORDER BY sec)),
es AS (SELECT *, CAST(sum(nw) OVER (PARTITION BY signature ORDER BY sec ROWS UNBOUNDED PRECEDING) AS BIGINT) AS episode FROM lg)"""


@REG.query("alert_episodes", f"{EPISODES} SELECT signature, episode, min(sec) AS first_seen, max(sec) AS last_seen, CAST(sum(n) AS BIGINT) AS count FROM es GROUP BY 1,2")
def alert_episodes(spark, sf):
    return S.episodes(matched(spark, sf), GRACE)


# the walk in SQL: each second points at the first one a window later, sends follow the pointers
WINDOWS = {0: 12 * HOUR, 1: 8 * HOUR, 3: 24 * HOUR}
NEXT = " ".join(f"WHEN {i} THEN min(sec) OVER (PARTITION BY signature, episode ORDER BY sec RANGE BETWEEN {w} FOLLOWING AND UNBOUNDED FOLLOWING)" for i, w in WINDOWS.items())
SENDS = EPISODES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", nx AS (SELECT *, CASE rule_ord {NEXT} END AS nxt, row_number() OVER (PARTITION BY signature, episode ORDER BY sec) AS rn,
  CAST(sum(n) OVER (PARTITION BY signature, episode ORDER BY sec ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS before FROM es WHERE rule_ord<>2),
ch AS (SELECT signature, episode, sec, nxt, before FROM nx WHERE rn=1 UNION ALL SELECT nx.signature, nx.episode, nx.sec, nx.nxt, nx.before FROM ch JOIN nx ON nx.signature=ch.signature AND nx.episode=ch.episode AND nx.sec=ch.nxt),
sn AS (SELECT signature, episode, sec AS sent_at, coalesce(before-lag(before) OVER (PARTITION BY signature, episode ORDER BY sec)-1,0) AS suppressed FROM ch)"""


@REG.query("alert_suppression", f"{SENDS} SELECT * FROM sn")
def alert_suppression(spark, sf):
    return S.suppress(matched(spark, sf), RULES, GRACE)


STATE = f"""{SENDS}, ep AS (SELECT signature, episode, min(sec) AS first_seen, max(sec) AS last_seen, CAST(sum(n) AS BIGINT) AS episode_count FROM es GROUP BY 1,2),
le AS (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY signature ORDER BY episode DESC)=1),
ls AS (SELECT signature, episode, max(sent_at) AS last_sent FROM sn GROUP BY 1,2),
sm AS (SELECT signature, alert, host, message AS sample_msg FROM m QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ts DESC, event_id DESC)=1),
sj AS (SELECT le.*, last_sent, alert, host, sample_msg FROM le LEFT JOIN ls USING (signature, episode) JOIN sm USING (signature)),
st AS (SELECT sj.signature, any_value(alert) AS alert, any_value(host) AS host, any_value(first_seen) AS first_seen, any_value(last_seen) AS last_seen, any_value(last_sent) AS last_sent,
 count(*) FILTER (m2.sec>=first_seen AND (last_sent IS NULL OR m2.sec>last_sent)) AS pending, any_value(episode_count) AS episode_count, any_value(sample_msg) AS sample_msg
 FROM sj JOIN (SELECT signature, sec FROM m) m2 USING (signature) GROUP BY sj.signature)"""


def state(spark, sf):
    m = matched(spark, sf)
    return S.dedup_state(m, S.suppress(m, RULES, GRACE), GRACE)


@REG.query("alert_dedup_state", f"{STATE} SELECT * FROM st")
def alert_dedup_state(spark, sf):
    return state(spark, sf)


ESC_NOW = NOW - 40 * HOUR


@REG.query("alert_escalations", f"""{STATE} SELECT signature, alert, host, 'management' AS escalation_group, ({NOW}-first_seen)//60 AS minutes, episode_count AS count FROM st
WHERE alert='FAULT' AND {NOW}-last_seen<=259200 AND {NOW}-first_seen>=14400""")
def alert_escalations(spark, sf):
    return S.escalations(state(spark, sf), RULES, NOW, 72 * HOUR)


@REG.query("alert_digest", f"""{FIRST} SELECT sec-sec%21600 AS window_start, 'network' AS grp, alert, count(*) AS events, count(DISTINCT host) AS hosts, min(ts) AS first_ts, max(ts) AS last_ts FROM m WHERE rule_ord=2 GROUP BY 1,2,3""")
def alert_digest(spark, sf):
    return S.digest(matched(spark, sf), RULES, 21600)


@REG.query("alert_digest_lines", f"""{FIRST} SELECT sec-sec%21600 AS window_start, 'network' AS grp, alert, ts, host, message FROM m WHERE rule_ord=2""")
def alert_digest_lines(spark, sf):
    return S.digest_lines(matched(spark, sf), RULES, 21600)


SEVERITY_SQL = "CASE event_id%6 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'fatal' WHEN 2 THEN 'warn' WHEN 3 THEN 'DEBUG' WHEN 4 THEN 'x' ELSE 'Information' END"
NORMAL = f"CASE upper({SEVERITY_SQL}) WHEN 'ERROR' THEN 'CRITICAL' WHEN 'FATAL' THEN 'CRITICAL' WHEN 'WARN' THEN 'WARNING' ELSE 'INFO' END"


def severities(spark, sf):
    raw = T.pick(F.col("event_id") % 6, ["ERROR", "fatal", "warn", "DEBUG", "x", "Information"])
    return log(spark, sf).withColumn("severity", S.normalize_severity(raw))


@REG.query("normalize_severity", f"SELECT event_id, {NORMAL} AS severity FROM events")
def normalize_severity(spark, sf):
    return severities(spark, sf).select("event_id", "severity")


@REG.query("severity_digest", f"""WITH {LOG}, s AS (SELECT *, program AS alert, {NORMAL} AS severity FROM v_log WHERE ts BETWEEN TIMESTAMP '2024-01-20' AND TIMESTAMP '2024-01-25'),
l AS (SELECT host, alert, message, ts FROM s QUALIFY row_number() OVER (PARTITION BY host, alert ORDER BY severity DESC, ts DESC, event_id DESC)=1),
g AS (SELECT host, alert, count(*) AS count, max(CASE severity WHEN 'INFO' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END) AS severity_score FROM s GROUP BY 1,2)
SELECT host, alert, count, severity_score, message AS latest_message, ts AS latest_time FROM g JOIN l USING (host, alert)""")
def severity_digest(spark, sf):
    rows = severities(spark, sf).withColumn("alert", F.col("program"))
    return S.severity_digest(rows, F.lit("2024-01-20").cast("timestamp_ntz"), F.lit("2024-01-25").cast("timestamp_ntz"))


FAULT_ONLY = [Rule("FAULT", ("error k=[0-4]",), "high", recovery=("view k=1",))]
STATED = f"""WITH {LOG}, ev AS (SELECT *, 'ACTIVE' AS kind, 'FAULT' AS alert FROM v_log WHERE regexp_matches(message,'error k=[0-4]') UNION ALL
 SELECT *, 'RECOVERED', 'FAULT' FROM v_log WHERE contains(message,'view k=1')),
sg AS (SELECT *, host||':'||alert AS signature, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM ev),
lt AS (SELECT signature, kind AS state, ts AS last_seen FROM sg QUALIFY row_number() OVER (PARTITION BY signature ORDER BY ts DESC, event_id DESC)=1),
fs AS (SELECT signature, min(ts) AS first_seen FROM sg GROUP BY 1), ss AS (SELECT signature, state, first_seen, last_seen FROM lt JOIN fs USING (signature))"""


def stated(spark, sf):
    return S.state_events(log(spark, sf), FAULT_ONLY)


@REG.query("alert_recoveries", f"{STATED} SELECT * FROM ss")
def alert_recoveries(spark, sf):
    return S.latest_state(stated(spark, sf))


@REG.query("active_alerts", f"{STATED} SELECT * FROM ss WHERE state='ACTIVE'")
def active_alerts(spark, sf):
    return S.active_alerts(S.latest_state(stated(spark, sf)))


@REG.query("stale_alerts", f"{STATED} SELECT * FROM ss WHERE state='ACTIVE' AND last_seen<TIMESTAMP '2024-01-30 22:00:00'")
def stale_alerts(spark, sf):
    return S.stale_alerts(S.latest_state(stated(spark, sf)), F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))


@REG.query("notify_on_activation", STATED.replace("WITH ", "WITH RECURSIVE ", 1) + """, ps AS (SELECT signature, sec, count(*) FILTER (kind='ACTIVE') AS n, max(CASE WHEN kind='RECOVERED' THEN 1 ELSE 0 END) AS cured FROM sg GROUP BY 1,2),
sp AS (SELECT *, CAST(sum(cured) OVER (PARTITION BY signature ORDER BY sec ROWS UNBOUNDED PRECEDING) AS BIGINT)-cured AS span FROM ps),
nx AS (SELECT *, min(sec) OVER (PARTITION BY signature, span ORDER BY sec RANGE BETWEEN 86400 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, row_number() OVER (PARTITION BY signature, span ORDER BY sec) AS rn FROM sp WHERE n>0),
ch AS (SELECT signature, span, sec, nxt FROM nx WHERE rn=1 UNION ALL SELECT nx.signature, nx.span, nx.sec, nx.nxt FROM ch JOIN nx ON nx.signature=ch.signature AND nx.span=ch.span AND nx.sec=ch.nxt)
SELECT nx.signature, nx.sec, nx.n, CASE WHEN rn=1 THEN 'NOTIFIED' WHEN ch.sec IS NOT NULL THEN 'SILENT' ELSE 'SUPPRESSED' END AS label FROM nx LEFT JOIN ch ON ch.signature=nx.signature AND ch.span=nx.span AND ch.sec=nx.sec""")
def notify_on_activation(spark, sf):
    return S.notify_on_activation(stated(spark, sf), 86400)


@REG.query("alert_prune", f"{STATE} SELECT signature, last_seen FROM st WHERE last_seen>={NOW}-604800")
def alert_prune(spark, sf):
    return S.prune(state(spark, sf), F.col("last_seen"), F.lit(NOW)).select("signature", "last_seen")


@REG.query("alert_recipients", f"""{FIRST} SELECT event_id, CASE rule_ord WHEN 0 THEN 'a@x,b@x,c@x' WHEN 1 THEN 'd@x' WHEN 2 THEN '' ELSE 'a@x,b@x' END AS "to",
 CASE rule_ord WHEN 2 THEN 'r2,r1' ELSE 'main,spare' END AS relays FROM m""")
def alert_recipients(spark, sf):
    out = S.recipients(S.match_rules(log(spark, sf), RULES), RULES, GROUPS, ("main", "spare"))
    return out.select("event_id", F.array_join("to", ",").alias("to"), F.array_join("relays", ",").alias("relays"))


SUBJECT = "CASE rule_ord WHEN 1 THEN '[low] BUY on '||host||': '||message WHEN 0 THEN '[high] FAULT on '||host WHEN 2 THEN '[info] NINE on '||host ELSE '[warning] ANY on '||host END"


@REG.query("render_subjects", f"{FIRST} SELECT event_id, {SUBJECT} AS subject FROM m")
def render_subjects(spark, sf):
    return S.subjects(S.match_rules(log(spark, sf), RULES), RULES).select("event_id", "subject")


@REG.query("render_html", f"""WITH {LOG} SELECT event_id, '<b>'||replace(replace(replace(message||' <&>''','&','&amp;'),'<','&lt;'),'>','&gt;') AS body FROM v_log""".replace(
    "'&gt;') AS body", "'&gt;')||'</b>' AS body").replace("message||' <&>'''", "message||' <&>'"))
def render_html(spark, sf):
    text = F.concat("message", F.lit(" <&>"))
    return log(spark, sf).select("event_id", S.render("<b>{{ message }}{{nothing}}</b>", {"message": text}, escape=True).alias("body"))


@REG.query("rule_test", f"""{ALL}, r AS (SELECT event_id, alert, CASE rule_ord WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'info' ELSE 'warning' END AS severity, {SUBJECT} AS subject FROM ma)
SELECT v_log.event_id, alert, severity, subject FROM v_log LEFT JOIN r USING (event_id)""")
def rule_test(spark, sf):
    return S.rule_test(log(spark, sf), RULES)


@REG.query("rule_coverage", f"""{ALL}, c AS (SELECT rule_ord, count(*) AS hits FROM ma GROUP BY 1)
SELECT r.i AS rule_ord, (['FAULT','BUY','NINE','ANY','NEVER'])[r.i+1] AS alert, coalesce(hits,0) AS hits, false AS catch_all, hits IS NULL AS unused FROM range(5) r(i) LEFT JOIN c ON c.rule_ord=r.i""")
def rule_coverage(spark, sf):
    return S.rule_stats(S.match_rules(log(spark, sf), RULES, "all"), RULES)
