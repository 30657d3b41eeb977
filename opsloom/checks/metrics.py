"""Registered counter, health, certificate and configuration queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.checks.registry import Registry, sql_floor_div
from opsloom.checks.views import COUNTERS, PROBES
from opsloom.operators import metrics as M
from opsloom.sources import tables as T

REG = Registry()


def raw_ports(spark, sf):
    """Each supplier as a device reply with one good, one short and one unnumbered port row."""
    s = T.table(spark, sf, "supplier")
    k = F.col("s_suppkey").cast("string")
    raw = F.concat(k, F.lit("/"), (F.col("s_suppkey") % 2).cast("string"), F.lit("/Up/1/1000MbpsFullDuplex/1518|x/0/Up/1/1/1|3/0|,"),
                   k, F.lit("/10/2/3/4/5/z/7/8|y/1/2/3/4/5/6/7/8|"))
    return s.select(F.col("s_suppkey").alias("switch"), raw.alias("raw"))


@REG.query("parse_port_stats", """SELECT s_suppkey AS switch, s_suppkey AS port, CASE WHEN s_suppkey%2=1 THEN 'fiber' ELSE 'copper' END AS media, 'Up' AS link, true AS autoneg,
 '1000MbpsFullDuplex' AS speed, '1518' AS mtu, 10 AS rx_ok, 2 AS rx_err, 3 AS rx_bcast, 4 AS tx_ok, 5 AS tx_err, 0 AS collisions, 7 AS tx_pause, 8 AS rx_pause FROM supplier""")
def parse_port_stats(spark, sf):
    return M.parse_port_stats(raw_ports(spark, sf))


WRAP = "CASE WHEN {n} IS NULL OR {o} IS NULL THEN NULL WHEN {n}>={o} THEN {n}-{o} ELSE {n}-{o}+{m} END"
LAGGED = f"""WITH {COUNTERS}, lg AS (SELECT *, lag(t) OVER w AS pt, lag(rx_ok) OVER w AS prx, lag(tx_ok) OVER w AS ptx, lag(rx_err) OVER w AS pre, lag(tx_err) OVER w AS pte
 FROM v_counters WINDOW w AS (PARTITION BY switch, port ORDER BY t, sample)),
dl AS (SELECT *, {WRAP.format(n='rx_ok', o='prx', m='CASE WHEN switch%5<>0 THEN 4294967296 END')} AS rx_delta, {WRAP.format(n='tx_ok', o='ptx', m='CASE WHEN switch%5<>0 THEN 4294967296 END')} AS tx_delta FROM lg)"""


@REG.query("counter_delta", f"{LAGGED} SELECT sample, rx_delta, tx_delta FROM dl")
def counter_delta(spark, sf):
    return M.counter_delta(T.counters(spark, sf)).select("sample", "rx_delta", "tx_delta")


RATE = "CASE WHEN epoch_us(t)-epoch_us(pt)>0 THEN round_even(rx_delta::DOUBLE/((epoch_us(t)-epoch_us(pt))/1e6::DOUBLE),1) END"


@REG.query("counter_rate", f"{LAGGED} SELECT sample, {RATE} AS rx_pps, {RATE.replace('rx_delta', 'tx_delta')} AS tx_pps FROM dl")
def counter_rate(spark, sf):
    return M.counter_rate(T.counters(spark, sf)).select("sample", "rx_pps", "tx_pps")


@REG.query("new_errors", f"""{LAGGED} SELECT sample, CASE WHEN pt IS NOT NULL THEN {WRAP.format(n='rx_err', o='pre', m=4294967296)}+{WRAP.format(n='tx_err', o='pte', m=4294967296)} END AS err_new FROM dl""")
def new_errors(spark, sf):
    return M.new_errors(T.counters(spark, sf)).select("sample", "err_new")


@REG.query("port_state", f"""WITH {COUNTERS} SELECT sample, CASE WHEN NOT admin THEN 'disabled' WHEN link THEN 'up' ELSE 'down' END AS state, rx_ok+coalesce(NULLIF(rx_err,0),0)+tx_err AS total,
 CASE WHEN link THEN 64 ELSE 33 END AS width FROM v_counters""")
def port_state(spark, sf):
    c = T.counters(spark, sf)
    parts = [F.col("rx_ok"), F.when(F.col("rx_err") != 0, F.col("rx_err")), F.col("tx_err")]
    return c.select("sample", M.port_state(F.col("admin"), F.col("link")).alias("state"), M.combined_counter(parts).alias("total"),
                    M.counter_bits(F.col("link")).alias("width"))


SPEEDS = ["1000MbpsFullDuplex", "100MbpsHalfDuplex", "10000MbpsFullDuplexFiber", "2500MbpsCopper", "", "2Gbps"]


@REG.query("short_speed", """SELECT s_suppkey AS k, CASE s_suppkey%6 WHEN 0 THEN '1G' WHEN 1 THEN '100M HDX' WHEN 2 THEN '10G' WHEN 3 THEN '2.5G' WHEN 4 THEN '' ELSE '2G' END AS speed FROM supplier""")
def short_speed(spark, sf):
    return T.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), M.short_speed(T.pick(F.col("s_suppkey") % 6, SPEEDS)).alias("speed"))


def ports(spark, sf):
    c = M.latest(T.counters(spark, sf), ["switch", "port"], ["t", "sample"])
    c = c.withColumn("alias", F.when(F.col("switch") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("al-"), "port")))
    labels = c.filter(F.col("switch") % 4 == 0).select("switch", "port", F.concat(F.lit("Lbl "), F.upper("port")).alias("label"))
    return M.port_label(c, labels).withColumn("state", M.port_state(F.col("admin"), F.col("link")))


PORTS = f"""WITH {COUNTERS}, lt AS (SELECT * FROM v_counters QUALIFY row_number() OVER (PARTITION BY switch, port ORDER BY t DESC, sample DESC)=1),
pl AS (SELECT *, CASE WHEN switch%4=0 THEN 'Lbl '||upper(port) WHEN switch%3<>0 THEN 'al-'||port ELSE '' END AS label, CASE WHEN switch%4=0 THEN 'dashboard' WHEN switch%3<>0 THEN 'switch' ELSE '' END AS label_src,
 CASE WHEN NOT admin THEN 'disabled' WHEN link THEN 'up' ELSE 'down' END AS state FROM lt)"""


@REG.query("port_labels", f"{PORTS} SELECT switch, port, label, label_src FROM pl")
def port_labels(spark, sf):
    return ports(spark, sf).select("switch", "port", "label", "label_src")


@REG.query("fleet_totals", f"""{PORTS} SELECT count(*) FILTER (state='up') AS up, count(*) FILTER (state='down') AS down, count(*) FILTER (state='disabled') AS disabled, count(DISTINCT switch) AS devices
 FROM pl WHERE contains(lower(concat_ws(' ', switch, port, label)),'lbl click')""")
def fleet_totals(spark, sf):
    return M.fleet_totals(ports(spark, sf), "LBL click")


@REG.query("latest_samples", f"{PORTS} SELECT switch, port, t, rx_ok, tx_ok FROM lt")
def latest_samples(spark, sf):
    return M.latest(T.counters(spark, sf), ["switch", "port"], ["t", "sample"]).select("switch", "port", "t", "rx_ok", "tx_ok")


@REG.query("latest_snapshot", """WITH p AS (SELECT user_id AS switch, ts AS t, event_type NOT IN ('error','signup') AND user_id<>7 AS ok, CAST(floor(value) AS BIGINT) AS ports FROM events),
l AS (SELECT switch, max(t) AS checked, arg_max(ok,t) AS lok, max(t) FILTER (ok) AS updated, arg_max(ports,t) FILTER (ok) AS ports FROM p GROUP BY 1)
SELECT switch, checked, updated, ports, NOT lok AND ports IS NOT NULL AS stale, NOT lok AND ports IS NULL AS unreachable FROM l""")
def latest_snapshot(spark, sf):
    polls = T.table(spark, sf, "events").select(
        F.col("user_id").alias("switch"), F.col("ts").alias("t"), (~F.col("event_type").isin("error", "signup") & (F.col("user_id") != 7)).alias("ok"),
        F.floor("value").cast("long").alias("ports"))
    return M.latest_snapshot(polls)


CPU = f"""{COUNTERS}, cp AS (SELECT CAST(switch AS VARCHAR)||port AS host, t, sample, total*4 AS total, total*4-((total*7)%(total*4+1)) AS idle FROM v_run)"""


def cpu_samples(spark, sf):
    c = T.counters(spark, sf, bits=40)
    total = F.col("rx_ok").cast("long") * 4
    return c.select(F.concat(F.col("switch").cast("string"), "port").alias("host"), "t", total.alias("total"), (total - (F.col("rx_ok").cast("long") * 7) % (total + 1)).alias("idle"))


@REG.query("cpu_busy", f"""WITH {CPU}, l AS (SELECT *, lag(total) OVER w AS pt, lag(idle) OVER w AS pi FROM cp WINDOW w AS (PARTITION BY host ORDER BY t))
SELECT host, t, CASE WHEN pt IS NULL THEN NULL WHEN total-pt>0 THEN CAST(round_even(((total-pt)-(idle-pi))*100.0::DOUBLE/(total-pt),0) AS INTEGER) ELSE 0 END AS busy_pct FROM l""")
def cpu_busy(spark, sf):
    return M.cpu_busy(cpu_samples(spark, sf)).select("host", "t", "busy_pct")


@REG.query("level_for", """SELECT event_id, CASE WHEN value>=90 THEN 'crit' WHEN value>=40 THEN 'warn' ELSE 'ok' END AS level,
 CASE WHEN value/50>=2.0 THEN 'crit' WHEN value/50>=1.0 OR value>=95 THEN 'warn' ELSE 'ok' END AS cpu_level FROM events""")
def level_for(spark, sf):
    return T.table(spark, sf, "events").select("event_id", M.level(F.col("value"), 40, 90).alias("level"),
                                               M.cpu_level(F.col("value") / 50, F.col("value"), 1.0, 2.0).alias("cpu_level"))


def disks(spark, sf):
    e = F.col("event_id")
    return T.table(spark, sf, "events").select(
        F.col("user_id").alias("host"), e.alias("ord"), T.pick(e % 5, ["/dev/sda1", "/dev/sdb1", "overlay", "/dev/sdc1", "tmp"]).alias("device"),
        T.pick(e % 7, ["ext4", "xfs", "ext4", "tmpfs", "btrfs", "ext4", "xfs"]).alias("fstype"),
        T.pick(e % 3, ["/", "/data", "/run/x"]).alias("mount"), (e % 101).alias("pct"))


DISKS = """d AS (SELECT user_id AS host, event_id AS ord, CASE event_id%5 WHEN 0 THEN '/dev/sda1' WHEN 1 THEN '/dev/sdb1' WHEN 2 THEN 'overlay' WHEN 3 THEN '/dev/sdc1' ELSE 'tmp' END AS device,
 CASE event_id%7 WHEN 1 THEN 'xfs' WHEN 3 THEN 'tmpfs' WHEN 4 THEN 'btrfs' WHEN 6 THEN 'xfs' ELSE 'ext4' END AS fstype, CASE event_id%3 WHEN 0 THEN '/' WHEN 1 THEN '/data' ELSE '/run/x' END AS mount, event_id%101 AS pct FROM events),
dk AS (SELECT * FROM d WHERE fstype<>'tmpfs' AND device<>'overlay' AND mount<>'/run/x' QUALIFY row_number() OVER (PARTITION BY host, device ORDER BY ord)=1),
dl AS (SELECT host, device, mount, fstype, pct, CASE WHEN pct>=90 THEN 'crit' WHEN pct>=80 THEN 'warn' ELSE 'ok' END AS level FROM dk)"""


@REG.query("disk_levels", f"WITH {DISKS} SELECT * FROM dl")
def disk_levels(spark, sf):
    return M.disk_levels(disks(spark, sf), 80, 90)


def containers(spark, sf):
    e = F.col("event_id")
    state = T.pick(e % 4, ["running", "running", "restarting", "exited"])
    status = F.when(e % 40 == 1, "Up 3 days (unhealthy)").when(state == "exited", F.concat(F.lit("Exited ("), (e % 3).cast("string"), F.lit(") 2 hours ago"))).otherwise("Up")
    return T.table(spark, sf, "events").filter((e % 4 != 2) | (F.col("user_id") % 5 == 0)).filter((e % 4 != 3) | (F.col("user_id") % 3 == 0)).select(
        F.col("user_id").alias("host"), state.alias("state"), status.alias("status"))


CONTAINERS = """c0 AS (SELECT user_id AS host, event_id AS e, CASE event_id%4 WHEN 2 THEN 'restarting' WHEN 3 THEN 'exited' ELSE 'running' END AS state FROM events
 WHERE (event_id%4<>2 OR user_id%5=0) AND (event_id%4<>3 OR user_id%3=0)),
c1 AS (SELECT *, e%40=1 OR state='restarting' OR (state='exited' AND e%3<>0) AS bad FROM c0),
cl AS (SELECT host, count(*) FILTER (state='running') AS running, count(*) AS total, count(*) FILTER (bad) AS problems, CASE WHEN count(*) FILTER (bad)>0 THEN 'warn' ELSE 'ok' END AS level FROM c1 GROUP BY 1)"""


@REG.query("container_problems", f"WITH {CONTAINERS} SELECT * FROM cl")
def container_problems(spark, sf):
    return M.container_problems(containers(spark, sf))


@REG.query("host_health", f"""WITH {DISKS}, {CONTAINERS}, dw AS (SELECT host, max(CASE level WHEN 'crit' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END) AS r FROM dl GROUP BY 1),
v AS (SELECT user_id AS host, max(CASE WHEN value>=300 THEN 2 WHEN value>=200 THEN 1 ELSE 0 END) AS r, max(CASE WHEN value>=320 THEN 2 WHEN value>=250 THEN 1 ELSE 0 END) AS q FROM events GROUP BY 1),
j AS (SELECT host, v.r AS c, v.q AS m, coalesce(dw.r,0) AS d, CASE WHEN cl.level='warn' THEN 1 ELSE 0 END AS k FROM v LEFT JOIN dw USING (host) LEFT JOIN cl USING (host))
SELECT host, (['ok','warn','crit'])[c+1] AS cpu, (['ok','warn','crit'])[m+1] AS memory, (['ok','warn','crit'])[d+1] AS disk, (['ok','warn','crit'])[k+1] AS containers, (['ok','warn','crit'])[greatest(c,m,d,k)+1] AS level FROM j""")
def host_health(spark, sf):
    ev = T.table(spark, sf, "events").select(F.col("user_id").alias("host"), "value")
    return M.host_health(ev.withColumn("level", M.level(F.col("value"), 200, 300)), ev.withColumn("level", M.level(F.col("value"), 250, 320)),
                         M.disk_levels(disks(spark, sf), 80, 90), M.container_problems(containers(spark, sf)))


STATUS = f"""{PROBES}, ps AS (SELECT *, CASE WHEN http_code='000' OR (own_proxy AND http_code='503') THEN 'down' ELSE 'up' END AS state, CAST(http_code AS INTEGER) AS code, CAST(floor(seconds*1000) AS BIGINT) AS ms FROM v_probes)"""


@REG.query("probe_status", f"WITH {STATUS} SELECT event_id, state, code, ms FROM ps")
def probe_status(spark, sf):
    return M.probe_status(T.probes(spark, sf)).select("event_id", "state", "code", "ms")


@REG.query("availability", f"""WITH {STATUS} SELECT url, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS window_start, count(*) FILTER (state='up') AS up, count(*) FILTER (state='down') AS down,
 median(ms) AS median_ms, max(ms) AS max_ms FROM ps GROUP BY 1,2""")
def availability(spark, sf):
    return M.availability(M.probe_status(T.probes(spark, sf)))


@REG.query("image_drift", """WITH c AS (SELECT p_partkey AS name, CASE WHEN p_partkey%11=0 THEN 'app@sha256:ab' ELSE p_brand||':'||p_type END AS image, 'id'||CAST(p_partkey%3 AS VARCHAR) AS image_id,
 CASE WHEN p_partkey%4=0 THEN '' ELSE 'c'||CAST(p_partkey%2 AS VARCHAR) END AS content, p_partkey AS created, p_partkey%13=0 AS auto_remove, p_partkey%17=0 AS excluded FROM part),
i AS (SELECT DISTINCT p_brand||':'||p_type AS tag, 'id1' AS tag_image_id, 'c1' AS tag_content, 1000 AS tag_created, CASE WHEN p_type='LARGE' THEN 'fail' ELSE 'ok' END AS pull FROM part WHERE p_brand<>'Brand#3'),
d AS (SELECT *, coalesce(tag_image_id<>image_id,false) AND CASE WHEN content<>'' THEN content<>coalesce(tag_content,'?') ELSE tag_created IS NULL OR tag_created>created END AS diff FROM c LEFT JOIN i ON image=tag)
SELECT name, image, CASE WHEN auto_remove THEN 'skipped (--rm)' WHEN excluded THEN 'excluded' WHEN contains(image,'@sha256:') THEN 'pinned by digest' WHEN diff AND coalesce(pull='fail',false) THEN 'UPDATE AVAILABLE (newer local image)'
 WHEN diff THEN 'UPDATE AVAILABLE' WHEN coalesce(pull='fail',false) THEN 'pull failed (local build or private registry?)' ELSE 'current' END AS status FROM d""")
def image_drift(spark, sf):
    k = F.col("p_partkey")
    part = T.table(spark, sf, "part")
    tag = F.concat("p_brand", F.lit(":"), "p_type")
    c = part.select(k.alias("name"), F.when(k % 11 == 0, "app@sha256:ab").otherwise(tag).alias("image"), F.concat(F.lit("id"), (k % 3).cast("string")).alias("image_id"),
                    F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("c"), (k % 2).cast("string"))).alias("content"), k.alias("created"),
                    (k % 13 == 0).alias("auto_remove"), (k % 17 == 0).alias("excluded"))
    i = part.filter("p_brand <> 'Brand#3'").select(tag.alias("tag"), F.lit("id1").alias("tag_image_id"), F.lit("c1").alias("tag_content"), F.lit(1000).alias("tag_created"),
                                                   F.when(F.col("p_type") == "LARGE", "fail").otherwise("ok").alias("pull")).distinct()
    return M.image_drift(c, i)


@REG.query("inventory_summary", """WITH c AS (SELECT s_suppkey AS name, CASE WHEN s_nationkey<>3 THEN 'p'||CAST(s_nationkey AS VARCHAR) END AS project, s_suppkey%2=0 AS run,
 ['/srv/'||CAST(s_suppkey%4 AS VARCHAR), 'vol'||CAST(s_suppkey%3 AS VARCHAR)] AS src FROM supplier),
u AS (SELECT coalesce(project,'(none)') AS project, unnest(src) AS s FROM c),
g AS (SELECT coalesce(project,'(none)') AS project, count(*) AS containers, CAST(sum(CASE WHEN run THEN 1 ELSE 0 END) AS BIGINT) AS running FROM c GROUP BY 1)
SELECT project, containers, running, (SELECT string_agg(DISTINCT s, ',' ORDER BY s) FROM u WHERE u.project=g.project) AS locations FROM g""")
def inventory_summary(spark, sf):
    k = F.col("s_suppkey")
    mount = lambda t, s: F.struct(F.lit(t).alias("type"), s.alias("source"), F.lit("/x").alias("destination"))
    rows = T.table(spark, sf, "supplier").select(
        k.alias("name"), F.when(F.col("s_nationkey") != 3, F.concat(F.lit("p"), F.col("s_nationkey").cast("string"))).alias("project"),
        F.when(k % 2 == 0, "running").otherwise("exited").alias("state"),
        F.array(mount("bind", F.concat(F.lit("/srv/"), (k % 4).cast("string"))), mount("volume", F.concat(F.lit("vol"), (k % 3).cast("string"))),
                mount("tmpfs", F.lit("none"))).alias("mounts"))
    return M.inventory(rows).withColumn("locations", F.array_join("locations", ","))


NOW = 1_700_000_000


@REG.query("cert_status", f"""WITH r AS (SELECT s_name AS label, s_suppkey%9<>0 AS enabled, 'h'||CAST(s_suppkey AS VARCHAR) AS host, 443 AS port, CASE WHEN s_suppkey%7<>0 THEN {NOW}+CAST(round(s_acctbal*1000) AS BIGINT) END AS na FROM supplier),
d AS (SELECT *, CAST(trunc((na-{NOW})/86400) AS BIGINT) AS days_left FROM r), s AS (SELECT *, CASE WHEN NOT enabled THEN 'DISABLED' WHEN days_left IS NULL THEN 'UNREACHABLE' WHEN days_left<0 THEN 'EXPIRED' WHEN days_left<=30 THEN 'EXPIRING' ELSE 'OK' END AS status FROM d)
SELECT label, host, port, days_left, status, status NOT IN ('DISABLED','OK') AS attention FROM s""")
def cert_status(spark, sf):
    k = F.col("s_suppkey")
    s = T.table(spark, sf, "supplier").withColumn("host", F.concat(F.lit("h"), k.cast("string"))).withColumn("port", F.lit(443))
    roster = s.select(F.col("s_name").alias("label"), (k % 9 != 0).alias("enabled"), "host", "port")
    certs = s.filter(k % 7 != 0).select("host", "port", (F.lit(NOW) + F.round(F.col("s_acctbal") * 1000).cast("long")).alias("not_after"))
    return M.cert_status(roster, certs, NOW)


@REG.query("fingerprint_status", """SELECT 'h'||CAST(s_suppkey AS VARCHAR) AS host, 443 AS port, CASE WHEN s_suppkey%5=0 OR s_suppkey%5=4 THEN 'no response' WHEN s_suppkey%3=0 THEN 'same' ELSE 'differs' END AS status FROM supplier""")
def fingerprint_status(spark, sf):
    k = F.col("s_suppkey")
    s = T.table(spark, sf, "supplier").withColumn("host", F.concat(F.lit("h"), k.cast("string"))).withColumn("port", F.lit(443))
    live = s.filter(k % 5 != 0).select("host", "port", F.when(k % 5 == 4, "").when(k % 3 == 0, "aa").otherwise("bb").alias("fingerprint"))
    return M.fingerprint_status(s.select("host", "port", F.lit("aa").alias("fingerprint")), live)


DRIFT = """w AS (SELECT c_nationkey AS host, 'Key'||CAST(c_custkey AS VARCHAR) AS k, CASE WHEN c_custkey%4=0 THEN 'B , a' ELSE c_mktsegment END AS v, c_custkey FROM customer),
j AS (SELECT host, lower(k) AS key, v AS recommended, CASE WHEN c_custkey%5=0 THEN 'not reported' WHEN c_custkey%4=0 THEN 'a,b' WHEN c_custkey%3=0 THEN 'other' ELSE lower(v) END AS running,
 CASE WHEN c_custkey%5=0 THEN false WHEN c_custkey%4=0 THEN true WHEN c_custkey%3=0 THEN false ELSE true END AS match, c_custkey IN (1,2) AS managed FROM w)"""


def drift(spark, sf):
    k = F.col("c_custkey")
    c = T.table(spark, sf, "customer").select(F.col("c_nationkey").alias("host"), F.concat(F.lit("Key"), k.cast("string")).alias("key"),
                                              F.when(k % 4 == 0, "B , a").otherwise(F.col("c_mktsegment")).alias("value"), k)
    run = c.filter(k % 5 != 0)
    one = run.filter(k % 4 != 0).select("host", F.upper("key").alias("key"), F.lit(0).alias("ord"), F.when(k % 3 == 0, "other").otherwise(F.lower("value")).alias("value"))
    two = run.filter(k % 4 == 0).select("host", "key", F.explode(F.array(F.struct(F.lit(1).alias("ord"), F.lit("b").alias("value")),
                                                                           F.struct(F.lit(0).alias("ord"), F.lit("a").alias("value")))).alias("x")).select("host", "key", "x.*")
    return M.config_drift(c.drop("c_custkey"), one.unionByName(two), ["key1", "key2"])


@REG.query("config_drift", f"WITH {DRIFT} SELECT * FROM j")
def config_drift(spark, sf):
    return drift(spark, sf)


@REG.query("config_compliance", f"""WITH {DRIFT}, g AS (SELECT host, count(*) FILTER (match) AS matches, count(*) AS total FROM j GROUP BY 1) SELECT *, {sql_floor_div('matches*100', 'total')} AS compliance_pct FROM g""")
def config_compliance(spark, sf):
    return M.compliance(drift(spark, sf))


@REG.query("audit_tail", """WITH l AS (SELECT CAST(epoch_us(ts) AS VARCHAR) AS ts, event_type AS action, event_id FROM events WHERE event_id%6<>0 AND event_type='error')
SELECT ts, action, '{"ts":"'||ts||'","action":"'||action||'"}' AS value FROM l ORDER BY ts DESC, value DESC LIMIT 200""")
def audit_tail(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    line = F.concat(F.lit('{"ts":"'), us, F.lit('","action":"'), "event_type", F.when(F.col("event_id") % 6 == 0, "").otherwise('"}'))
    return M.audit_tail(T.table(spark, sf, "events").select(line.alias("value")), "ERROR", 200)


@REG.query("login_throttle", """WITH a AS (SELECT event_id, user_id%10 AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events),
c AS (SELECT event_id, count(*) OVER (PARTITION BY key ORDER BY sec RANGE BETWEEN 36000 PRECEDING AND 1 PRECEDING) AS recent FROM a)
SELECT event_id, recent, recent>=12 AS blocked FROM c""")
def login_throttle(spark, sf):
    attempts = T.table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).alias("key"), "ts")
    return M.login_throttle(attempts, 12, 36000).select("event_id", "recent", "blocked")
