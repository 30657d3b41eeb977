"""Category assignment: user rules, source labels, built-in patterns, fallbacks, corrections.

Transactions carry merchant, description, amount_cents and, where used, user_id, source_label,
category_source and account_type. An assignment is the struct (category, source, confidence).
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.columns import let
from opsloom.functions.merchant import tidy_payee
from opsloom.functions.patterns import occurs
from opsloom.functions.rules import BUILTIN_RULES, INCOME_HINT, OWN_TRANSFER, TRANSFER_HINT, kind_of
from opsloom.operators.categories import direction, group_for

BLANK_LABELS = ("", "uncategorized", "uncategorised", "none")


def assignment(category: Column, source: str, confidence: float) -> Column:
    return F.struct(category.alias("category"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))


def builtin_assignment(description: Column, merchant: Column, amount_cents: Column, account_type: Column) -> Column:
    """First pattern on either text whose sign fits, else a fallback by sign; one projection."""
    def chain(both: Column) -> Column:
        def hit(rule):
            pattern, _, sign = rule
            found = occurs(both, pattern)
            return found if sign == 0 else ((amount_cents > 0) if sign > 0 else (amount_cents <= 0)) & found
        first, *rest = BUILTIN_RULES
        return reduce(lambda acc, r: acc.when(hit(r), F.lit(r[1])), rest, F.when(hit(first), F.lit(first[1])))

    # the two texts are tried as one, a line each: no pattern crosses a line break
    named = let(F.concat(F.upper(description), F.lit("\n"), F.upper(merchant)), chain)
    owed = account_type.isin("credit_card", "loan")
    return let(named, lambda n: F.when(n.isNotNull(), assignment(n, "rule", 0.8))
               .when((amount_cents > 0) & owed, assignment(F.lit("Credit Card Payment"), "rule", 0.5))
               .when(amount_cents > 0, assignment(F.lit("Other Income"), "rule", 0.4))
               .otherwise(assignment(F.lit("Uncategorized"), "none", 0.0)))


def label_kind(label: Column) -> Column:
    """Kind a source label stands for: transfer hint, income hint, its group's kind, else expense."""
    return let(kind_of(group_for(label)), lambda group: (
        F.when(label.rlike("(?i)" + TRANSFER_HINT) | (F.coalesce(group, F.lit("")) == "transfer"), "transfer")
        .when(label.rlike("(?i)" + INCOME_HINT) | (F.coalesce(group, F.lit("")) == "income"), "income").otherwise("expense")))


def apply_user_rules(txns: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``user_category``: the newest of the user's rules that fits.

    Exact merchants are an equi-join. "Contains" rules travel as one array per user (people write them, so the
    list is short) and are filtered in place: no pair of rule and row is ever emitted.
    """
    by = ["user_id"]
    newest = F.struct(F.col("created_at"), F.col("rule_id"))
    exact = rules.filter(F.col("match_type") == "merchant_exact").groupBy(*by, F.upper("pattern").alias("__m")).agg(
        F.max(F.struct(newest.alias("at"), F.col("category").alias("category"))).alias("__exact"))
    contains = rules.filter(F.col("match_type") == "contains").groupBy(*by).agg(
        F.collect_list(F.struct(newest.alias("at"), F.col("category").alias("category"), F.upper("pattern").alias("pattern"))).alias("__list"))
    out = txns.withColumn("__m", F.upper("merchant")).join(exact, [*by, "__m"], "left").join(contains, by, "left")
    text = F.upper("description")
    found = F.array_max(F.transform(
        F.filter(F.coalesce("__list", F.array().cast("array<struct<at:struct<created_at:timestamp,rule_id:string>,category:string,pattern:string>>")),
                 lambda r: F.contains(text, r["pattern"])),
        lambda r: F.struct(r["at"].alias("at"), r["category"].alias("category"))))
    best = F.greatest(F.col("__exact"), found)
    return out.withColumn("user_category", best["category"]).drop("__m", "__exact", "__list")


def _finish(out: DataFrame, picked: Column) -> DataFrame:
    out = out.withColumn("__a", picked)
    if "category_kind" not in out.columns:
        out = out.withColumn("category_kind", kind_of(F.col("__a.category")))
    else:
        out = out.withColumn("category_kind", F.coalesce(kind_of(F.col("__a.category")), F.col("category_kind")))
    return out.withColumn("category", F.col("__a.category")).withColumn("category_source", F.col("__a.source")).withColumn(
        "confidence", F.col("__a.confidence")).withColumn(
        "direction", direction(F.col("category_kind"), F.col("amount_cents"))).drop("__a", "category_kind")


def _account_type(txns: DataFrame) -> Column:
    return F.col("account_type") if "account_type" in txns.columns else F.lit("checking")


def categorize(txns: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """User rules (0.99), then built-in patterns (0.8), then fallbacks; sets category, source, confidence, direction."""
    base = builtin_assignment(F.col("description"), F.col("merchant"), F.col("amount_cents"), _account_type(txns))
    if rules is None:
        return _finish(txns, base)
    out = apply_user_rules(txns, rules)
    user = F.when(F.col("user_category").isNotNull(), assignment(F.col("user_category"), "user_rule", 0.99))
    return _finish(out, F.coalesce(user, base)).drop("user_category")


def categorize_imported(txns: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """User rules, then the source label (0.95), then an own-account transfer (0.9), then built-in patterns."""
    label = F.trim("source_label")
    labelled = F.when(~F.lower(F.coalesce(label, F.lit(""))).isin(*BLANK_LABELS), assignment(label, "import", 0.95))
    moved = F.when(F.col("merchant").rlike("(?i)" + OWN_TRANSFER) | F.col("description").rlike("(?i)" + OWN_TRANSFER),
                   assignment(F.lit("Transfer"), "rule", 0.9))
    base = builtin_assignment(F.col("description"), F.col("merchant"), F.col("amount_cents"), _account_type(txns))
    out = txns
    if rules is not None:
        out = apply_user_rules(txns, rules)
        user = F.when(F.col("user_category").isNotNull(), assignment(F.col("user_category"), "user_rule", 0.99))
        picked = F.coalesce(user, labelled, moved, base)
    else:
        picked = F.coalesce(labelled, moved, base)
    out = out.withColumn("category_kind", label_kind(F.col("source_label")))
    return _finish(out, picked).drop("user_category")


def learn_correction(txns: DataFrame, rules: DataFrame, corrections: DataFrame) -> dict[str, DataFrame]:
    """Apply corrections (user_id, id, category, kind): the row itself becomes the user's, other rows of the
    merchant follow unless the user set them, and the merchant's exact rule is written or replaced."""
    fixed = corrections.select("user_id", "id", F.col("category").alias("__own"), F.col("kind").alias("__ownkind"))
    marked = txns.join(fixed, ["user_id", "id"], "left")
    taught = marked.filter(F.col("__own").isNotNull()).groupBy("user_id", "merchant").agg(
        F.max_by(F.struct(F.col("__own").alias("category"), F.col("__ownkind").alias("kind")), "id").alias("__rule"))
    both = marked.join(taught, ["user_id", "merchant"], "left")
    own = F.col("__own").isNotNull()
    follow = ~own & F.col("__rule").isNotNull() & (F.col("category_source") != "user")
    category = F.when(own, F.col("__own")).when(follow, F.col("__rule.category")).otherwise(F.col("category"))
    kind = F.when(own, F.col("__ownkind")).when(follow, F.col("__rule.kind"))
    new = both.select(
        *[c for c in txns.columns if c not in ("category", "category_source", "confidence", "direction")],
        category.alias("category"),
        F.when(own, "user").when(follow, "user_rule").otherwise(F.col("category_source")).alias("category_source"),
        F.when(own, 1.0).when(follow, 0.99).otherwise(F.col("confidence")).alias("confidence"),
        F.when(own | follow, direction(kind, F.col("amount_cents"))).otherwise(F.col("direction")).alias("direction"),
        follow.alias("__changed"))
    learned = taught.select("user_id", F.upper("merchant").alias("pattern"), F.col("__rule.category").alias("category"))
    kept = rules.join(learned.select("user_id", "pattern", F.lit("merchant_exact").alias("match_type")),
                      ["user_id", "pattern", "match_type"], "left_anti")
    written = learned.select("user_id", F.sha2(F.concat_ws("|", "user_id", "pattern"), 256).alias("rule_id"),
                             F.lit("merchant_exact").alias("match_type"), "pattern", "category",
                             F.current_timestamp().alias("created_at"))
    return {"transactions": new.drop("__changed"), "rules": kept.unionByName(written, allowMissingColumns=True),
            "changed": new.groupBy("user_id").agg(F.count_if("__changed").alias("changed"))}


def recategorize(txns: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Rules again on every row the user did not set; the others pass through unchanged."""
    own = F.coalesce(F.col("category_source") == "user", F.lit(False))
    mine, rest = txns.filter(own), txns.filter(~own)
    return mine.unionByName(categorize(rest, rules).select(*txns.columns))


DATA_VERSION = 4


def apply_fixes(tables: dict[str, DataFrame], from_version: int) -> dict[str, DataFrame]:
    """Versioned repairs of stored rows, each idempotent; rows the user set keep their category.

    3: tidy payees of rows that came with a source label. 4: give labelled rows their label's category back.
    """
    out = dict(tables)
    if from_version < 3:
        labelled = F.col("source_label").isNotNull()
        out["transactions"] = out["transactions"].withColumn(
            "merchant", F.when(labelled, tidy_payee(F.col("merchant"))).otherwise(F.col("merchant")))
    if from_version < 4:
        txns = out["transactions"]
        redo = F.col("source_label").isNotNull() & F.col("category_source").isin("import", "rule", "none")
        again = categorize_imported(txns.filter(redo), out.get("rules")).select(*txns.columns)
        out["transactions"] = txns.filter(~F.coalesce(redo, F.lit(False))).unionByName(again)
    out["version"] = DATA_VERSION
    return out
