"""Counters, levels, probes, inventory, certificates, configuration drift, audit and login throttling."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import none_if_blank
from opsloom.functions.numbers import floor_quotient, quotient
from opsloom.plans.hotkeys import lag_over, recent_counts

COUNTER = "decimal(20,0)"


# --- port counters ---------------------------------------------------------------------------------------------

def parse_port_stats(raw: DataFrame) -> DataFrame:
    """``raw`` text "summary rows,counter rows" (rows by ``|``, fields by ``/``) -> one row per port.

    Rows that are too short or have no port number are skipped; a counter that is not a number is 0.
    """
    keep = [c for c in raw.columns if c != "raw"]
    tables = F.split(F.trim("raw"), ",")
    rows = lambda i: F.split(F.coalesce(F.try_element_at(F.col("__t"), F.lit(i)), F.lit("")), r"\|")
    base = raw.withColumn("__t", tables)
    cells = lambda i: base.select(*keep, F.explode(rows(i)).alias("__r")).withColumn("v", F.split("__r", "/"))
    number = lambda i: F.coalesce(F.try_element_at(F.col("v"), F.lit(i)), F.lit(""))
    value = lambda i: F.when(number(i).rlike(r"^\d+$"), number(i)).otherwise("0").cast(COUNTER)
    summary = cells(1).filter((F.size("v") >= 6) & number(1).rlike(r"^\d+$")).select(
        *keep, number(1).cast("int").alias("port"), F.when(number(2) == "1", "fiber").otherwise("copper").alias("media"),
        number(3).alias("link"), (number(4) == "1").alias("autoneg"), number(5).alias("speed"), number(6).alias("mtu"))
    names = ("rx_ok", "rx_err", "rx_bcast", "tx_ok", "tx_err", "collisions", "tx_pause", "rx_pause")
    counters = cells(2).filter((F.size("v") >= 7) & number(1).rlike(r"^\d+$")).select(
        *keep, number(1).cast("int").alias("port"), *[value(i + 2).alias(n) for i, n in enumerate(names)])
    return summary.join(counters, [*keep, "port"], "full")


def delta(new: Column, old: Column, bits: Column) -> Column:
    """new - old; a fall is one wrap of a 32- or 64-bit counter, unknown for any other width."""
    wrapped = F.when(bits == 32, new - old + F.lit(1 << 32).cast(COUNTER)).when(
        bits == 64, new - old + F.lit("18446744073709551616").cast("decimal(21,0)"))
    return F.when(new.isNull() | old.isNull(), None).when(new >= old, new - old).otherwise(wrapped).cast(COUNTER)


def with_previous(samples: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Each sample (switch, port, t, ...) beside the port's previous one; a day's samples are sorted together."""
    keyed = samples.withColumn("__day", F.to_date("t") if bucket is None else bucket)
    order = ["t"] + (["sample"] if "sample" in samples.columns else [])
    values = {f"prev_{c}": F.col(c) for c in ("t", "rx_ok", "tx_ok", "rx_err", "tx_err") if c in samples.columns}
    return lag_over(keyed, ["switch", "port"], "__day", order, values).drop("__day")


def counter_delta(samples: DataFrame) -> DataFrame:
    p = with_previous(samples)
    return p.withColumn("rx_delta", delta(F.col("rx_ok"), F.col("prev_rx_ok"), F.col("bits"))).withColumn(
        "tx_delta", delta(F.col("tx_ok"), F.col("prev_tx_ok"), F.col("bits")))


def counter_rate(samples: DataFrame) -> DataFrame:
    """Deltas per second to one decimal; null on the first sample and where no time has passed."""
    d = counter_delta(samples)
    seconds = (F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("prev_t").cast("timestamp"))) / 1e6
    per = lambda c: F.when(F.col("__s") > 0, F.bround(F.col(c).cast("double") / F.col("__s"), 1))
    return d.withColumn("__s", seconds).withColumn("rx_pps", per("rx_delta")).withColumn("tx_pps", per("tx_delta")).drop("__s")


def new_errors(samples: DataFrame) -> DataFrame:
    """Rise of receive plus transmit errors since the last sample (32-bit wrap), null without one."""
    p = with_previous(samples)
    rise = lambda c: F.coalesce(delta(F.col(c), F.col(f"prev_{c}"), F.lit(32)), F.lit(0).cast(COUNTER))
    return p.withColumn("err_new", F.when(F.col("prev_t").isNotNull(), rise("rx_err") + rise("tx_err")))


def port_state(admin: Column, link: Column) -> Column:
    return F.when(~admin, "disabled").when(link, "up").otherwise("down")


def combined_counter(parts: Sequence[Column]) -> Column:
    """Sum of unicast, multicast and broadcast counters (null counts as 0); pair with ``counter_bits``."""
    return sum((F.coalesce(p.cast(COUNTER), F.lit(0).cast(COUNTER)) for p in parts[1:]), F.coalesce(parts[0].cast(COUNTER), F.lit(0).cast(COUNTER)))


def counter_bits(wide: Column) -> Column:
    """64 for one wide counter; 33 marks the sum of two 32-bit ones, whose wrap is unknown."""
    return F.when(wide, 64).otherwise(33)


def short_speed(text: Column) -> Column:
    """"1000MbpsFullDuplex" -> "1G"; half duplex stays marked."""
    out = F.coalesce(text, F.lit(""))
    for old, new in (("Mbps", "M"), ("Gbps", "G"), ("10000M", "10G"), ("2500M", "2.5G"), ("1000M", "1G"), ("FullDuplex", ""),
                     ("HalfDuplex", " HDX"), ("Copper", ""), ("Fiber", "")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(out)


def port_label(ports: DataFrame, labels: DataFrame) -> DataFrame:
    """A label given on the dashboard (switch, port, label) wins over the device's own alias."""
    own = labels.select("switch", "port", none_if_blank(F.col("label")).alias("__own"))
    out = ports.join(own, ["switch", "port"], "left")
    alias = none_if_blank(F.col("alias"))
    return (out.withColumn("label", F.coalesce("__own", alias, F.lit("")))
            .withColumn("label_src", F.when(F.col("__own").isNotNull(), "dashboard").when(alias.isNotNull(), "switch").otherwise(""))
            .drop("__own"))


def latest(samples: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Newest sample per key, combined on the map side."""
    rest = [c for c in samples.columns if c not in keys]
    return samples.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def latest_snapshot(polls: DataFrame) -> DataFrame:
    """Newest good sample per device with ``stale`` when a later poll failed; polls: switch, t, ok, ports."""
    last = polls.groupBy("switch").agg(F.max("t").alias("checked"), F.max_by("ok", "t").alias("__ok"),
                                       F.max(F.when(F.col("ok"), F.col("t"))).alias("updated"),
                                       F.max_by(F.when(F.col("ok"), F.col("ports")), F.when(F.col("ok"), F.col("t"))).alias("ports"))
    return last.select("switch", "checked", "updated", "ports", (~F.col("__ok") & F.col("ports").isNotNull()).alias("stale"),
                       (~F.col("__ok") & F.col("ports").isNull()).alias("unreachable"))


def fleet_totals(ports: DataFrame, text: str | None = None, fields: Sequence[str] = ("switch", "port", "label")) -> DataFrame:
    """Ports per state, over the ports whose names contain the text in any case."""
    if text:
        hay = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in fields]))
        ports = ports.filter(F.contains(hay, F.lit(text.lower())))
    return ports.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("up", "down", "disabled")], F.countDistinct("switch").alias("devices"))


# --- levels and health --------------------------------------------------------------------------------------------

RANKS = {"ok": 0, "warn": 1, "crit": 2}


def level(value: Column, warn, crit) -> Column:
    return F.when(value >= crit, "crit").when(value >= warn, "warn").otherwise("ok")


def _rank(text: Column) -> Column:
    return F.when(text == "crit", 2).when(text == "warn", 1).otherwise(0)


def _named(rank: Column) -> Column:
    return F.when(rank >= 2, "crit").when(rank >= 1, "warn").otherwise("ok")


def worst(*levels: Column) -> Column:
    ranks = [_rank(x) for x in levels]
    return _named(F.greatest(*ranks) if len(ranks) > 1 else ranks[0])


def worst_of(column: Column) -> Column:
    """Aggregate: the worst level of a group."""
    return _named(F.max(_rank(column)))


def cpu_busy(samples: DataFrame, keys: Sequence[str] = ("host",)) -> DataFrame:
    """Busy percent between two cumulative (total, idle) samples; 0 where no time passed."""
    p = lag_over(samples.withColumn("__day", F.to_date("t")), list(keys), "__day", ["t"], {"__pt": F.col("total"), "__pi": F.col("idle")})
    dt, di = F.col("total") - F.col("__pt"), F.col("idle") - F.col("__pi")
    busy = F.when(dt > 0, F.bround((dt - di) * F.lit(100.0) / dt).cast("int")).otherwise(0)
    return p.withColumn("busy_pct", F.when(F.col("__pt").isNotNull(), busy)).drop("__day", "__pt", "__pi")


def cpu_level(load_per_core: Column, busy: Column, warn, crit) -> Column:
    return worst(level(load_per_core, warn, crit), F.when(busy >= 95, "warn").otherwise("ok"))


# fixed values: what is not a real filesystem
PSEUDO_TYPES = ["tmpfs", "devtmpfs", "overlay", "squashfs", "efivarfs", "ramfs", "nsfs", "fuse.lxcfs"]
PSEUDO_DEVICES = ["none", "udev", "shm", "overlay"]
PSEUDO_MOUNTS = r"^/(run|snap|var/lib/docker|proc|sys|dev)(/|$)"


def disk_levels(disks: DataFrame, warn: int, crit: int) -> DataFrame:
    """Real filesystems, the first mount per device (ord), with a level; disks: host, ord, device, fstype, mount, pct."""
    real = disks.filter(~F.col("fstype").isin(PSEUDO_TYPES) & ~F.col("device").isin(PSEUDO_DEVICES) & ~F.col("mount").rlike(PSEUDO_MOUNTS))
    first = real.groupBy("host", "device").agg(F.min_by(F.struct("mount", "fstype", "pct"), "ord").alias("d")).select("host", "device", "d.*")
    return first.withColumn("level", level(F.col("pct"), warn, crit))


def container_problem(state: Column, status: Column) -> Column:
    return (F.when(F.contains(status, F.lit("(unhealthy)")), "unhealthy").when(state == "restarting", "restarting")
            .when((state == "exited") & ~status.startswith("Exited (0)"), "exited"))


def container_problems(containers: DataFrame) -> DataFrame:
    """Per host: running of total and how many containers have a problem."""
    bad = container_problem(F.col("state"), F.col("status"))
    return containers.groupBy("host").agg(
        F.count_if(F.col("state") == "running").alias("running"), F.count("*").alias("total"), F.count(bad).alias("problems")).withColumn(
        "level", F.when(F.col("problems") > 0, "warn").otherwise("ok"))


def host_health(cpu: DataFrame, memory: DataFrame, disks: DataFrame, containers: DataFrame) -> DataFrame:
    """One row per host: the four levels and the worst. Each input is keyed by host and has ``level``."""
    named = lambda df, n: df.groupBy("host").agg(worst_of(F.col("level")).alias(n))
    out = named(cpu, "cpu").join(named(memory, "memory"), "host", "full").join(named(disks, "disk"), "host", "full").join(
        named(containers, "containers"), "host", "full")
    parts = [F.coalesce(c, F.lit("ok")) for c in ("cpu", "memory", "disk", "containers")]
    return out.select("host", *[p.alias(n) for p, n in zip(parts, ("cpu", "memory", "disk", "containers"))], worst(*parts).alias("level"))


def probe_status(probes: DataFrame) -> DataFrame:
    """000 or no code is down, any HTTP answer is up, except 502-504 from the own proxy."""
    code = F.when(F.col("http_code").rlike(r"^\d{3}$"), F.col("http_code")).otherwise("000")
    down = (code == "000") | (F.col("own_proxy") & code.isin("502", "503", "504"))
    return probes.withColumn("state", F.when(down, "down").otherwise("up")).withColumn("code", code.cast("int")).withColumn(
        "ms", F.floor(F.col("seconds") * 1000).cast("long"))


def availability(status: DataFrame, width: str = "1 day") -> DataFrame:
    """Per link and window: up, down, share up and exact median response time."""
    return status.groupBy("url", F.window(F.col("ts").cast("timestamp"), width).alias("w")).agg(
        F.count_if(F.col("state") == "up").alias("up"), F.count_if(F.col("state") == "down").alias("down"),
        F.median("ms").alias("median_ms"), F.max("ms").alias("max_ms")).select(
        "url", F.unix_seconds("w.start").alias("window_start"), "up", "down", "median_ms", "max_ms")


def image_drift(containers: DataFrame, images: DataFrame) -> DataFrame:
    """Status per container against the image its tag now names.

    containers: name, image, image_id, content, created, auto_remove, excluded; images: tag, tag_image_id,
    tag_content, tag_created, pull (ok, fail or null).
    """
    j = containers.join(images, containers["image"] == images["tag"], "left")
    differs_id = F.col("tag_image_id").isNotNull() & (F.col("tag_image_id") != F.col("image_id"))
    known = none_if_blank(F.col("content"))
    by_time = F.col("created").isNull() | F.col("tag_created").isNull() | (F.col("tag_created") > F.col("created"))
    differs = differs_id & F.when(known.isNotNull(), ~known.eqNullSafe(F.col("tag_content"))).otherwise(by_time)
    failed = F.coalesce(F.col("pull") == "fail", F.lit(False))
    status = (F.when(F.col("auto_remove"), "skipped (--rm)").when(F.col("excluded"), "excluded")
              .when(F.contains("image", F.lit("@sha256:")), "pinned by digest")
              .when(differs & failed, "UPDATE AVAILABLE (newer local image)").when(differs, "UPDATE AVAILABLE")
              .when(failed, "pull failed (local build or private registry?)").otherwise("current"))
    return j.select("name", "image", status.alias("status"))


def inventory(inspected: DataFrame) -> DataFrame:
    """Per compose project: containers, running ones and the data locations they mount.

    inspected: name, project, state, mounts array<struct<type, source, destination>>.
    """
    mounts = F.filter("mounts", lambda m: m["type"].isin("bind", "volume"))
    flat = inspected.select(F.coalesce("project", F.lit("(none)")).alias("project"), "name", "state",
                            F.explode_outer(F.transform(mounts, lambda m: m["source"])).alias("source"))
    per = flat.groupBy("project", "name").agg(F.max((F.col("state") == "running").cast("int")).alias("r"), F.collect_set("source").alias("s"))
    # a project's mounts are few and distinct by container; they end as one sorted list per project
    return per.groupBy("project").agg(
        F.count("*").alias("containers"), F.sum("r").alias("running"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))).alias("locations"))


# --- certificates and configuration ----------------------------------------------------------------------------------

def cert_status(roster: DataFrame, certs: DataFrame, now_s: int, warn_days: int = 30) -> DataFrame:
    """roster: label, enabled, host, port; certs: host, port, not_after (epoch seconds). Whole days toward zero."""
    j = roster.join(certs, ["host", "port"], "left")
    days = quotient((F.col("not_after") - F.lit(now_s)).cast("long"), F.lit(86400))
    status = (F.when(~F.col("enabled"), "DISABLED").when(F.col("days_left").isNull(), "UNREACHABLE").when(F.col("days_left") < 0, "EXPIRED")
              .when(F.col("days_left") <= warn_days, "EXPIRING").otherwise("OK"))
    return j.withColumn("days_left", days).withColumn("status", status).withColumn(
        "attention", ~F.col("status").isin("DISABLED", "OK")).select("label", "host", "port", "days_left", "status", "attention")


def fingerprint_status(expected: DataFrame, live: DataFrame) -> DataFrame:
    """Per device: same, differs, or no response; both sides have host, port, fingerprint."""
    seen = live.select("host", "port", none_if_blank(F.col("fingerprint")).alias("__live"))
    return expected.join(seen, ["host", "port"], "left").select(
        "host", "port", F.when(F.col("__live").isNull(), "no response").when(F.col("__live") == F.col("fingerprint"), "same").otherwise("differs").alias("status"))


def normal_value(text: Column) -> Column:
    """Lower case, no blanks, the comma list sorted."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[ \t]", ""), ",")
    return F.array_join(F.array_sort(F.filter(parts, lambda p: p != "")), ",")


def config_drift(recommended: DataFrame, running: DataFrame, managed: Sequence[str] = ()) -> DataFrame:
    """Every recommended (host, key, value) with what runs; a key that occurs several times is one comma list."""
    got = running.groupBy("host", F.lower("key").alias("key")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), ",").alias("running"))
    want = recommended.select("host", F.lower("key").alias("key"), F.col("value").alias("recommended"))
    j = want.join(got, ["host", "key"], "left")
    same = F.coalesce(normal_value(F.col("running")) == normal_value(F.col("recommended")), F.lit(False))
    return j.select("host", "key", "recommended", F.coalesce("running", F.lit("not reported")).alias("running"),
                    same.alias("match"), F.col("key").isin(list(managed)).alias("managed") if managed else F.lit(False).alias("managed"))


def compliance(drift: DataFrame) -> DataFrame:
    return drift.groupBy("host").agg(F.count_if("match").alias("matches"), F.count("*").alias("total")).withColumn(
        "compliance_pct", floor_quotient(F.col("matches") * 100, F.col("total")))


# --- audit and throttling -----------------------------------------------------------------------------------------------

def audit_tail(lines: DataFrame, text: str | None, n: int) -> DataFrame:
    """Newest ``n`` JSON lines (value) that contain the text in any case; broken lines are dropped.

    The text is looked for first, so only lines that hold it are parsed.
    """
    rows = lines.filter(F.contains(F.lower("value"), F.lit(text.lower()))) if text else lines
    rows = rows.withColumn("record", F.try_parse_json("value")).filter(F.col("record").isNotNull())
    return rows.select(F.try_variant_get("record", "$.ts", "string").alias("ts"), F.try_variant_get("record", "$.action", "string").alias("action"),
                       "value").orderBy(F.desc("ts"), F.desc("value")).limit(n)


def login_throttle(attempts: DataFrame, limit: int = 10, window_s: int = 300, keys: Sequence[str] = ("key",)) -> DataFrame:
    """Mark attempts that come after ``limit`` or more in the ``window_s`` seconds before them."""
    timed = attempts.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))
    return recent_counts(timed, list(keys), "sec", window_s, "recent").withColumn("blocked", F.col("recent") >= limit)
