"""Staging, de-duplication, commit and reconciliation of imported statement rows.

Staged rows carry import_id, account_id, line_no, date, description, amount_cents (and user_id if present).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.functions.merchant import normalize_text
from opsloom.functions.rules import ACCOUNT_TYPES, first_match
from opsloom.plans.hotkeys import running_sum

LINES_PER_BLOCK = 100_000
ALREADY = "Already imported (duplicate) — excluded."
NEAR = "Possible duplicate: an existing transaction has the same date and amount. Review before committing."
DONE = ("rolled_back", "failed", "preview")


def dedupe_files(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Files (user_id, path, content) whose bytes the user has not imported yet; undone imports do not count."""
    seen = imports.filter(~F.col("status").isin(*DONE)).select("user_id", "sha256").distinct()
    return files.withColumn("sha256", F.sha2("content", 256)).join(seen, ["user_id", "sha256"], "left_anti")


def _scope(df: DataFrame) -> list[str]:
    return [c for c in ("user_id", "account_id") if c in df.columns]


def fingerprint(rows: DataFrame, text_chars: int | None = None) -> DataFrame:
    """Add ``occurrence`` (0-based repeat of account, date, cents and normalised text in file order) and
    ``fingerprint`` (account, date, cents, all letters and digits of the text, occurrence).

    ``text_chars`` keeps only that many letters and digits, so that texts which differ later are one row.
    Copies of one row may be a large share of a file, so repeats are counted in blocks of lines.
    """
    per_file = [c for c in ("import_id",) if c in rows.columns]
    norm = rows.withColumn("__text", normalize_text(F.col("description"))).withColumn(
        "__block", F.floor(F.col("line_no") / LINES_PER_BLOCK))
    keys = [*per_file, *_scope(rows), "date", "amount_cents", "__text"]
    seen = running_sum(norm, keys, "__block", ["line_no"], F.lit(1), "__nth").withColumn("occurrence", F.col("__nth") - 1)
    letters = F.regexp_replace("__text", "[^A-Z0-9]", "")
    letters = letters if text_chars is None else F.substring(letters, 1, text_chars)
    key = F.concat_ws("|", F.col("account_id"), F.date_format("date", "yyyy-MM-dd"), F.col("amount_cents").cast("string"),
                      letters, F.col("occurrence").cast("string"))
    return seen.withColumn("fingerprint", F.when(F.col("date").isNotNull() & F.col("amount_cents").isNotNull(), F.sha2(key, 256))
                           ).drop("__text", "__block", "__nth")


def flag_duplicates(staged: DataFrame, txns: DataFrame) -> DataFrame:
    """Add ``duplicate_of`` (the committed row with this fingerprint in the account) and ``include``."""
    keys = [*_scope(staged), "fingerprint"]
    known = txns.groupBy(*keys).agg(F.min("id").alias("duplicate_of"))
    ready = F.col("date").isNotNull() & F.col("amount_cents").isNotNull()
    return staged.join(known, keys, "left").withColumn("include", ready & F.col("duplicate_of").isNull())


def flag_near_duplicates(staged: DataFrame, txns: DataFrame) -> DataFrame:
    """Add ``warning``: exact duplicate, or same account, date and amount inside the import's date span."""
    scope = _scope(staged)
    near = txns.select(*scope, "date", "amount_cents").distinct().withColumn("__near", F.lit(True))
    out = staged.join(near, [*scope, "date", "amount_cents"], "left")
    return out.withColumn("warning", F.when(F.col("duplicate_of").isNotNull(), ALREADY)
                          .when(F.col("__near"), NEAR)).drop("__near")


def commit_rows(staged: DataFrame, txns: DataFrame) -> DataFrame:
    """New rows to append: included, not yet in the account, the first of equal fingerprints in the batch."""
    keys = [*_scope(staged), "fingerprint"]
    ready = staged.filter(F.col("include") & F.col("date").isNotNull() & F.col("amount_cents").isNotNull())
    fresh = ready.join(txns.select(*keys).distinct(), keys, "left_anti")
    order = [c for c in ("import_id", "line_no") if c in staged.columns]
    rest = [c for c in staged.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return first.select(*keys, "__r.*")


def commit_counts(staged: DataFrame, committed: DataFrame) -> DataFrame:
    """Per import: rows new, duplicate (known before or repeated in the batch) and skipped."""
    new = committed.groupBy("import_id").agg(F.count("*").alias("__new"))
    ready = F.col("date").isNotNull() & F.col("amount_cents").isNotNull()
    totals = staged.groupBy("import_id").agg(
        F.count("*").alias("__all"), F.count_if(~ready | (~F.col("include") & F.col("duplicate_of").isNull())).alias("rows_skipped"))
    return totals.join(new, "import_id", "left").select(
        "import_id", F.coalesce("__new", F.lit(0)).alias("rows_new"),
        (F.col("__all") - F.col("rows_skipped") - F.coalesce("__new", F.lit(0))).alias("rows_duplicate"), "rows_skipped")


def rollback(txns: DataFrame, import_ids: Sequence[str]) -> DataFrame:
    return txns.filter(F.col("import_id").isNull() | ~F.col("import_id").isin(*import_ids))


def discard(staged: DataFrame, txns: DataFrame, import_ids: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return rollback(staged, import_ids), rollback(txns, import_ids)


def reconcile(imports: DataFrame, rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Statement sum against the balance change; every dated row counts, duplicates included.

    ``imports`` has import_id, account_id, opening_cents, closing_cents; ``accounts`` account_id, account_type.
    """
    total = rows.filter(F.col("date").isNotNull()).groupBy("import_id").agg(F.sum("amount_cents").alias("__sum"))
    owed = F.col("account_type").isin("credit_card", "loan")
    change = F.col("closing_cents") - F.col("opening_cents")
    diff = F.coalesce("__sum", F.lit(0)) - F.when(owed, -change).otherwise(change)
    return (
        imports.join(total, "import_id", "left").join(accounts.select("account_id", "account_type"), "account_id", "left")
        .withColumn("diff_cents", diff)
        .withColumn("status", F.when(F.col("diff_cents").isNull(), "committed")
                    .when(F.col("diff_cents") == 0, "reconciled").otherwise("unbalanced")).drop("__sum"))


def guess_account_type(label: Column) -> Column:
    return first_match(label, ACCOUNT_TYPES, ignore_case=True, default=F.lit("checking"))


def resolve_accounts(rows: DataFrame, aliases: DataFrame, accounts: DataFrame) -> DataFrame:
    """Add account_id and account_status to rows with ``account_label``.

    A remembered alias wins (with a null account it means "skip"), then an account of that name in any case.
    """
    known = aliases.select(F.col("label").alias("account_label"), F.col("account_id").alias("__alias"), F.lit(True).alias("__seen"))
    named = accounts.groupBy(F.lower(F.trim("name")).alias("__low")).agg(F.max("account_id").alias("__named"))
    out = rows.join(known, "account_label", "left").withColumn("__low", F.lower(F.trim("account_label"))).join(named, "__low", "left")
    account = F.when(F.col("__seen"), F.col("__alias")).otherwise(F.col("__named"))
    return (out.withColumn("account_id", account)
            .withColumn("account_status", F.when(account.isNotNull(), "mapped").when(F.col("__seen"), "skipped").otherwise("needs_account"))
            .drop("__alias", "__seen", "__named", "__low"))


def account_summary(staged: DataFrame) -> DataFrame:
    """Per account label of a multi-account import, in label order."""
    return staged.groupBy("account_label").agg(
        F.count("*").alias("rows"), F.min("date").alias("from_date"), F.max("date").alias("to_date"),
        F.count_if(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("net_cents"),
        F.max("account_status").alias("status")).withColumn(
        "suggested_type", guess_account_type(F.col("account_label"))).orderBy("account_label")
