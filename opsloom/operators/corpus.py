"""Scanning and rewriting a text corpus by an ordered list of find rules.

Rules come from a small rules file and are compiled on the driver into column expressions. Documents carry
doc_id, path and text (or binary content); messages carry author, committer and message.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsloom.functions.linediff import line_hunks

MARK = "***REMOVED***"
SEPARATOR = "==>"
SAMPLE_BYTES = 8000


# --- rules -----------------------------------------------------------------------------------------------------

def parse_rules(lines: DataFrame) -> DataFrame:
    """(line_no, raw) -> line_no, raw, kind, find, replacement; comments and blank lines are dropped."""
    kept = lines.withColumn("raw", F.regexp_replace("raw", r"\r$", "")).filter(
        (F.trim("raw") != "") & ~F.ltrim("raw").startswith("#"))
    at = F.locate(SEPARATOR, F.col("raw"))
    body = F.when(at > 0, F.substring("raw", F.lit(1), at - 1)).otherwise(F.col("raw"))
    out = kept.withColumn("__body", body).withColumn(
        "replacement", F.when(at > 0, F.substring("raw", at + len(SEPARATOR), F.length("raw"))).otherwise(MARK))
    kind = F.when(F.col("__body").startswith("regex:"), "regex").when(F.col("__body").startswith("glob:"), "glob").otherwise("literal")
    find = F.regexp_replace("__body", "^(regex:|glob:|literal:)", "")
    return out.withColumn("kind", kind).withColumn("find", find).withColumn("valid", F.col("find") != "").drop("__body")


def glob_pattern(glob: str) -> str:
    """Unanchored pattern of a glob; dots and line breaks count as any character."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2 if glob[i + 1:i + 2] in ("!", "]") else i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            inner = glob[i + 1:close]
            out.append("[" + ("^" + inner[1:] if inner.startswith("!") else inner).replace("\\", "\\\\") + "]")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)" + "".join(out)


@dataclass(frozen=True)
class FindRule:
    line_no: int
    raw: str
    kind: str
    find: str
    replacement: str

    @property
    def label(self) -> str:
        return self.find if self.kind == "literal" else f"{self.kind}:{self.find}"

    def found(self, text: Column) -> Column:
        if self.kind == "literal":
            return F.contains(text, F.lit(self.find))
        return text.rlike(self.find if self.kind == "regex" else glob_pattern(self.find))

    def found_any_case(self, text: Column, lower: Column) -> Column:
        if self.kind == "literal":
            return F.contains(lower, F.lit(self.find.lower()))
        return self.found(text) if self.kind == "regex" else text.rlike("(?i)" + glob_pattern(self.find))

    def rewritten(self, text: Column) -> Column:
        if self.kind == "literal":
            return F.replace(text, F.lit(self.find), F.lit(self.replacement))
        # the replacement is text; only "\1" refers to a group of a regex rule
        safe = self.replacement.replace("$", r"\$")
        if self.kind == "regex":
            return F.regexp_replace(text, self.find, re.sub(r"\\(\d)", r"$\1", safe))
        return F.regexp_replace(text, glob_pattern(self.find), safe.replace("\\", "\\\\") if "\\" in self.replacement else safe)


#: kind, what to find, and after the arrow what to put there
RULE_LINE = re.compile(rf"(?:(regex|glob|literal):)?(.*?)(?:{SEPARATOR}(.*))?", re.S)


def compile_rules(lines: Iterable[str]) -> list[FindRule]:
    """Rules of a rules file, numbered by line; blank lines and comments are none, a rule needs something to find."""
    numbered = [(n, line.rstrip("\r\n")) for n, line in enumerate(lines, 1)]
    parts = [(n, raw, RULE_LINE.fullmatch(raw).groups()) for n, raw in numbered if raw.strip()[:1] not in ("", "#")]
    empty = [n for n, _, (_, find, _) in parts if not find]
    if empty or not parts:
        raise ValueError(f"nothing to find on lines {empty}" if empty else "no rules")
    return [FindRule(n, raw, kind or "literal", find, MARK if put is None else put) for n, raw, (kind, find, put) in parts]


def digest_of_lines(parsed: DataFrame) -> DataFrame:
    """SHA-256 of the lines of a rules table (a rules file is short: its lines meet in one row)."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "raw")))
    return parsed.agg(F.sha2(F.concat(F.array_join(F.transform(lines, lambda x: x["raw"]), "\n"), F.lit("\n")), 256).alias("rules_sha256"))


def change_guard(marked: DataFrame, live: DataFrame) -> DataFrame:
    """Refs (ref, sha) that differ between the verified state and now."""
    a, b = marked.select("ref", F.col("sha").alias("was")), live.select("ref", F.col("sha").alias("now"))
    return a.join(b, "ref", "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select("ref", "was", "now")


# --- scanning --------------------------------------------------------------------------------------------------

def is_binary(content: Column) -> Column:
    """A zero byte among the first 8000."""
    return F.locate("\x00", F.decode(F.substring(content, 1, SAMPLE_BYTES), "ISO-8859-1")) > 0


def distinct_content(docs: DataFrame, content: str = "text") -> DataFrame:
    """Each distinct content once with its first path (by doc_id); only hashes and paths are shuffled."""
    return docs.select(F.sha2(F.col(content).cast("binary"), 256).alias("sha"), "path", "doc_id").groupBy("sha").agg(
        F.min_by("path", "doc_id").alias("first_path"), F.count("*").alias("copies"))


def _flags(text: Column, rules: Sequence[FindRule]) -> tuple[Column, Column]:
    """Arrays of rule ordinals: exact hits, and near misses (other case only; never for regex rules).

    Near misses are what matches in any letter case and is no exact hit, so no pattern runs twice for one flag.
    """
    lower = F.lower(text)
    exact = F.array_compact(F.array(*[F.when(r.found(text), F.lit(i)) for i, r in enumerate(rules)]))
    other = [F.when(r.found_any_case(text, lower), F.lit(i)) for i, r in enumerate(rules) if r.kind != "regex"]
    any_case = F.array_compact(F.array(*other)) if other else F.array().cast("array<int>")
    return exact, F.array_except(any_case, exact)


def scan_items(docs: DataFrame, rules: Sequence[FindRule]) -> DataFrame:
    """One row per distinct content: sha, first path, hits, near.

    Matching runs where the text lies, before the shuffle by hash, so texts never move; copies of one content
    meet as small rows that combine on the map side. Binary items are passed over.
    """
    exact, near = _flags(F.col("text"), rules)
    return docs.filter(~F.coalesce(is_binary(F.col("text").cast("binary")), F.lit(False))).select(F.sha2(F.col("text"), 256).alias("sha"), "doc_id", "path", exact.alias("hits"), near.alias("near")).groupBy("sha").agg(
        F.min_by(F.struct("path", "hits", "near"), "doc_id").alias("r")).select("sha", "r.path", "r.hits", "r.near")


def scan(docs: DataFrame, messages: DataFrame, rules: Sequence[FindRule]) -> DataFrame:
    """Per rule: distinct items and paths that match, near-miss paths, matching messages and identities."""
    items = scan_items(docs, rules)
    hit = items.select("sha", "path", F.explode("hits").alias("rule_ord")).groupBy("rule_ord").agg(
        F.count("*").alias("blobs"), F.countDistinct("path").alias("paths"))
    near = items.select("path", F.explode("near").alias("rule_ord")).groupBy("rule_ord").agg(F.countDistinct("path").alias("near_misses"))
    exact, _ = _flags(F.col("message"), rules)
    said = messages.select(F.explode(exact).alias("rule_ord")).groupBy("rule_ord").agg(F.count("*").alias("messages"))
    who = messages.select(F.explode(F.array("author", "committer")).alias("ident")).distinct()
    lower = F.lower("ident")
    named = F.array_compact(F.array(*[F.when(r.found_any_case(F.col("ident"), lower), F.lit(i)) for i, r in enumerate(rules)]))
    idents = who.select(F.explode(named).alias("rule_ord")).groupBy("rule_ord").agg(F.count("*").alias("idents"))
    labels = docs.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(r.label) for r in rules])).alias("rule_ord", "rule"))
    out = labels
    for part in (hit, near, said, idents):
        out = out.join(part, "rule_ord", "left")
    return out.na.fill(0, ["blobs", "paths", "near_misses", "messages", "idents"])


def scan_paths(docs: DataFrame, rules: Sequence[FindRule], top: int = 25) -> DataFrame:
    """The first ``top`` matching paths of each rule in order; the rank limit is applied before the shuffle."""
    pairs = scan_items(docs, rules).select("path", F.explode("hits").alias("rule_ord")).distinct()
    rank = F.row_number().over(Window.partitionBy("rule_ord").orderBy("path"))
    return pairs.withColumn("n", rank).filter(F.col("n") <= top).select("rule_ord", "n", "path")


def total_hits(scanned: DataFrame, include_messages: bool = True) -> DataFrame:
    extra = F.col("messages") if include_messages else F.lit(0)
    return scanned.agg(F.coalesce(F.sum(F.col("blobs") + extra), F.lit(0)).alias("total_hits"))


# --- rewriting -------------------------------------------------------------------------------------------------

def redact(docs: DataFrame, rules: Sequence[FindRule], column: str = "text") -> DataFrame:
    """Apply the rules in order; each sees what the one before it left."""
    return docs.withColumn(column, reduce(lambda text, r: r.rewritten(text), rules, F.col(column)))


def verify_clean(rewritten: DataFrame, messages: DataFrame, rules: Sequence[FindRule], include_messages: bool = True) -> DataFrame:
    """What still matches per rule; item hits of a rule whose own replacement holds its find text do not count."""
    kept = [i for i, r in enumerate(rules) if _still(r)]
    after = scan(rewritten, messages, rules)
    items = F.when(F.col("rule_ord").isin(kept), F.lit(0)).otherwise(F.col("blobs")) if kept else F.col("blobs")
    said = F.col("messages") if include_messages else F.lit(0)
    return after.select("rule_ord", "rule", (items + said).alias("left")).withColumn("clean", F.col("left") == 0)


def _still(rule: FindRule) -> bool:
    if rule.kind == "literal":
        return rule.find in rule.replacement
    return re.search(rule.find if rule.kind == "regex" else glob_pattern(rule.find), rule.replacement) is not None


def preview_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Changed items with the lines that went and came (as sets of lines)."""
    a = before.select("doc_id", "path", F.col("text").alias("__old"))
    b = after.select("doc_id", F.col("text").alias("__new"))
    pair = a.join(b, "doc_id").filter(~F.col("__old").eqNullSafe(F.col("__new")))
    old, new = F.split("__old", "\n"), F.split("__new", "\n")
    return pair.select("doc_id", "path", F.array_except(old, new).alias("removed"), F.array_except(new, old).alias("added"))


def preview_rewrite(docs: DataFrame, rules: Sequence[FindRule]) -> DataFrame:
    """The same preview without a join: both versions of a row come from one scan."""
    new = reduce(lambda text, r: r.rewritten(text), rules, F.col("text"))
    pair = docs.withColumn("__new", new).filter(F.col("__new") != F.col("text"))
    a, b = F.split("text", "\n"), F.split("__new", "\n")
    return pair.select("doc_id", "path", F.array_except(a, b).alias("removed"), F.array_except(b, a).alias("added"))


def preview_hunks(docs: DataFrame, rules: Sequence[FindRule], context: int = 1) -> DataFrame:
    """Items that the rules change, with what goes and comes in the order of the lines, repeated lines included, and lines of
    context around it: (doc_id, path, hunks). Both versions come from one scan; only changed items reach the comparison."""
    new = reduce(lambda text, r: r.rewritten(text), rules, F.col("text"))
    pair = docs.select("doc_id", "path", "text", new.alias("__new")).filter(F.col("__new") != F.col("text"))
    return pair.select("doc_id", "path", line_hunks(F.col("text"), F.col("__new"), context).alias("hunks"))


# --- secrets in settings -----------------------------------------------------------------------------------------

# fixed values: names that mark a secret
SECRET = r"(PASS|PASSWD|PASSWORD|SECRET|TOKEN|APIKEY|API_KEY|PRIVATE|CREDENTIAL|AUTH|_KEY$|^KEY$)"
SECRET_YAML = (r"^([ \t]*-?[ \t]*\"?[A-Za-z0-9_]*([Pp][Aa][Ss][Ss]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Kk][Ee][Yy]|"
               r"[Cc][Rr][Ee][Dd][Ee][Nn][Tt][Ii][Aa][Ll])[A-Za-z0-9_]*\"?[ \t]*[:=][ \t]*).+$")


def redact_env(line: Column) -> Column:
    """KEY=value with a secret key keeps only the key; comments stay."""
    at = F.locate("=", line)
    key = F.regexp_replace(F.when(at > 0, F.substring(line, F.lit(1), at - 1)).otherwise(line), r"^\s*(export\s+)?", "")
    secret = (at > 0) & ~line.rlike(r"^\s*#") & F.upper(key).rlike(SECRET)
    return F.when(secret, F.concat(F.substring(line, F.lit(1), at), F.lit("<redacted>"))).otherwise(line)


def redact_yaml(line: Column) -> Column:
    return F.regexp_replace(line, SECRET_YAML, "$1<redacted>")
