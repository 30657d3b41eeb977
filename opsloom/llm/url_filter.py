"""URL filters: host-suffix and path-prefix expressions, a join on short hash prefixes, full digests to confirm."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables of up to so many rows go to every task; larger ones meet salted expressions.
SMALL_RULES = 100_000


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From after the host to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", digest_prefix: int = 8, salts: int = 16,
               names: tuple[str, str, str, str] = ("host", "path", "rule", "verdict")) -> DataFrame:
    """``pages`` with host, path, the rule that decides and its verdict (``default`` where no rule fits).

    ``rules`` has ``host``, ``path`` (beginning with ``/``) and ``verdict``. A rule fits its host and all
    subdomains if the path begins with the rule's path, character by character. The longest rule text wins;
    of equal rules the least verdict in order of letters. Rules with a null in any of the three are no rules.

    A null url, or one without ``://``, has an empty host and path, which no rule with a host fits. Rows are
    judged one by one: repeated rows and ids get equal results. A given column with one of the ``names`` is
    refused.

    Distinct hosts and paths are expanded into the suffixes and prefixes of lengths that occur among the
    rules; each expression is a SHA-256 digest. The join compares ``digest_prefix`` hex digits, and the full
    digest confirms. Few rules go to the tasks as they are; otherwise expressions are salted, so that a
    common host is no hot key.
    """
    clash = {c.lower() for c in pages.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"pages already have {sorted(clash)}")
    host_name, path_name, rule_name, verdict_name = names
    known = (rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("verdict").alias("v")).filter("h <> '' AND p IS NOT NULL AND v IS NOT NULL")
             .groupBy("h", "p").agg(F.min("v").alias("v")).withColumn("d", F.sha2(F.concat_ws("\n", "h", "p"), 256)))
    shape = known.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("h", r"\."))).alias("labels"), F.collect_set(F.length("p")).alias("lengths")).first()
    parts = pages.select("*", host_of(F.col(url)).alias(host_name), path_of(F.col(url)).alias(path_name))
    distinct = parts.select(F.col(f"`{host_name}`").alias("host"), F.col(f"`{path_name}`").alias("path")).filter("host <> ''").distinct()
    # A suffix of k labels is what follows the k-th last dot; only label counts and path lengths of rules matter.
    suffixes = F.filter(F.transform(F.array(*[F.lit(k) for k in sorted(shape["labels"])]) if shape["labels"] else F.array().cast("array<int>"),
                                    lambda k: F.when(F.size(F.split("host", r"\.")) >= k, F.array_join(
                                        F.slice(F.split("host", r"\."), -k, k), "."))), lambda s: s.isNotNull())
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in sorted(shape["lengths"])]) if shape["lengths"] else F.array().cast("array<int>"),
                                    lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = (distinct.withColumn("h", F.explode(suffixes)).withColumn("p", F.explode(prefixes))
                   .withColumn("d", F.sha2(F.concat_ws("\n", "h", "p"), 256)).withColumn("short", F.substring("d", 1, digest_prefix)))
    lookup = known.select(F.col("d").alias("full"), F.substring("d", 1, digest_prefix).alias("short"), F.concat("h", "p").alias("rule"), "v")
    if shape["n"] <= SMALL_RULES:
        met = expressions.join(F.broadcast(lookup), "short")
    else:
        salted = expressions.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(salts)))
        met = salted.join(lookup.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))), ["short", "salt"])
    best = met.filter("d = full").groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("v"))).alias("best"))
    best = best.select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("best.rule").alias("__rule"), F.col("best.v").alias("__verdict"))
    on = (parts[host_name] == best["__h"]) & (parts[path_name] == best["__p"])
    return parts.join(best, on, "left").select(*[parts[c] for c in parts.columns], F.col("__rule").alias(rule_name), F.coalesce("__verdict", F.lit(default)).alias(verdict_name))
