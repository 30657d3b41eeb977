"""Registered queries on staging, commit, reconciliation, merchants and categories."""
from __future__ import annotations

from pyspark.sql import functions as F

from opsloom.checks.registry import Registry, sql_first_match, sql_pick, sql_text
from opsloom.checks.views import CHARGES, LEDGER
from opsloom.functions import merchant as M
from opsloom.functions import rules as R
from opsloom.operators import categories as C
from opsloom.operators import categorize as G
from opsloom.operators import imports as I
from opsloom.sources import tables as T

REG = Registry()


def staged_charges(spark, sf):
    return T.charges(spark, sf).withColumn("import_id", F.concat(F.lit("new-"), "account_id"))


def known_charges(spark, sf):
    old = T.charges(spark, sf).filter(F.col("line_no") % 3 == 0).withColumn("import_id", F.concat(F.lit("old-"), "account_id"))
    return I.fingerprint(old)


FP = """
raw AS (SELECT *, 'new-'||account_id AS import_id, trim(regexp_replace(upper(description),'\\s+',' ','g')) AS norm FROM v_charges),
oldraw AS (SELECT * REPLACE ('old-'||account_id AS import_id) FROM raw WHERE line_no%3=0),
fp0 AS (SELECT *, row_number() OVER (PARTITION BY import_id, account_id, date, amount_cents, norm ORDER BY line_no)-1 AS occurrence
 FROM (SELECT * FROM raw UNION ALL SELECT * FROM oldraw)),
fp AS (SELECT *, sha256(account_id||'|'||strftime(date,'%Y-%m-%d')||'|'||CAST(amount_cents AS VARCHAR)||'|'||regexp_replace(norm,'[^A-Z0-9]','','g')||'|'||CAST(occurrence AS VARCHAR)) AS fingerprint FROM fp0),
st AS (SELECT * FROM fp WHERE import_id LIKE 'new-%'), tx AS (SELECT * FROM fp WHERE import_id LIKE 'old-%')
"""
WITH_FP = f"WITH {CHARGES}, {FP}"


@REG.query("fingerprint_rows", f"{WITH_FP} SELECT id, occurrence, fingerprint FROM st")
def fingerprint_rows(spark, sf):
    return I.fingerprint(staged_charges(spark, sf)).select("id", "occurrence", "fingerprint")


FLAGGED = f"""{WITH_FP}, k AS (SELECT account_id, fingerprint, min(id) AS duplicate_of FROM tx GROUP BY 1,2),
fl AS (SELECT st.*, k.duplicate_of, k.duplicate_of IS NULL AS include FROM st LEFT JOIN k USING (account_id, fingerprint)),
nr AS (SELECT DISTINCT account_id, date, amount_cents, true AS near FROM tx)"""


@REG.query("flag_already_imported", f"{FLAGGED} SELECT id, duplicate_of, include FROM fl")
def flag_already_imported(spark, sf):
    return I.flag_duplicates(I.fingerprint(staged_charges(spark, sf)), known_charges(spark, sf)).select("id", "duplicate_of", "include")


@REG.query("flag_possible_duplicates", f"""{FLAGGED}
SELECT id, CASE WHEN duplicate_of IS NOT NULL THEN {sql_text(I.ALREADY)} WHEN near THEN {sql_text(I.NEAR)} END AS warning
FROM fl LEFT JOIN nr USING (account_id, date, amount_cents)""")
def flag_possible_duplicates(spark, sf):
    known = known_charges(spark, sf)
    flagged = I.flag_duplicates(I.fingerprint(staged_charges(spark, sf)), known)
    return I.flag_near_duplicates(flagged, known).select("id", "warning")


COMMIT = f"""{FLAGGED}, cm AS (SELECT * FROM fl WHERE include QUALIFY row_number() OVER (PARTITION BY account_id, fingerprint ORDER BY import_id, line_no)=1)"""


@REG.query("commit_rows", f"{COMMIT} SELECT id, account_id, amount_cents, import_id FROM cm")
def commit_rows(spark, sf):
    known = known_charges(spark, sf)
    flagged = I.flag_duplicates(I.fingerprint(staged_charges(spark, sf)), known)
    return I.commit_rows(flagged, known).select("id", "account_id", "amount_cents", "import_id")


@REG.query("commit_counts", f"""{COMMIT}, n AS (SELECT import_id, count(*) AS n FROM cm GROUP BY 1)
SELECT import_id, coalesce(max(n),0) AS rows_new, count(*)-coalesce(max(n),0) AS rows_duplicate, 0 AS rows_skipped FROM fl LEFT JOIN n USING (import_id) GROUP BY 1""")
def commit_counts(spark, sf):
    known = known_charges(spark, sf)
    flagged = I.flag_duplicates(I.fingerprint(staged_charges(spark, sf)), known)
    return I.commit_counts(flagged, I.commit_rows(flagged, known))


@REG.query("rollback_import", f"WITH {LEDGER} SELECT import_id, count(*) AS n FROM v_ledger WHERE import_id NOT IN ('imp-7-1998','imp-8-1999') GROUP BY 1")
def rollback_import(spark, sf):
    return I.rollback(T.ledger(spark, sf), ["imp-7-1998", "imp-8-1999"]).groupBy("import_id").agg(F.count("*").alias("n"))


@REG.query("reconcile_imports", f"""
WITH {LEDGER}, s AS (SELECT import_id, account_id, sum(amount_cents) AS total, count(*) AS n FROM v_ledger GROUP BY 1,2),
i AS (SELECT *, CASE WHEN n%4<>0 THEN 1000 END AS opening_cents, CAST(1000+CASE WHEN CAST(substr(account_id,6) AS INTEGER)%5=0 THEN -total ELSE total END+CASE WHEN n%3=0 THEN 7 ELSE 0 END AS BIGINT) AS closing_cents,
 CASE WHEN CAST(substr(account_id,6) AS INTEGER)%5=0 THEN 'credit_card' ELSE 'checking' END AS account_type FROM s),
d AS (SELECT *, CAST(total-CASE WHEN account_type='credit_card' THEN opening_cents-closing_cents ELSE closing_cents-opening_cents END AS BIGINT) AS diff_cents FROM i)
SELECT import_id, diff_cents, CASE WHEN diff_cents IS NULL THEN 'committed' WHEN diff_cents=0 THEN 'reconciled' ELSE 'unbalanced' END AS status FROM d""")
def reconcile_imports(spark, sf):
    rows = T.ledger(spark, sf)
    card = F.col("account_id").substr(6, 4).cast("int") % 5 == 0
    imports = rows.groupBy("import_id", "account_id").agg(F.sum("amount_cents").alias("t"), F.count("*").alias("n")).select(
        "import_id", "account_id", F.when(F.col("n") % 4 != 0, F.lit(1000)).alias("opening_cents"),
        (F.lit(1000) + F.when(card, -F.col("t")).otherwise(F.col("t")) + F.when(F.col("n") % 3 == 0, 7).otherwise(0)).alias("closing_cents"))
    accounts = rows.select("account_id").distinct().withColumn("account_type", F.when(card, "credit_card").otherwise("checking"))
    return I.reconcile(imports, rows, accounts).select("import_id", "diff_cents", "status")


LABEL_SQL = "c_mktsegment||' '||CASE c_custkey%6 WHEN 0 THEN 'Visa' WHEN 1 THEN 'Savings' WHEN 2 THEN 'Auto Loan' WHEN 3 THEN 'cash box' WHEN 4 THEN 'HYSA' ELSE 'Main' END"
KINDS = ["Visa", "Savings", "Auto Loan", "cash box", "HYSA", "Main"]


def label_rows(spark, sf):
    return T.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("line_no"), F.concat("c_mktsegment", F.lit(" "), T.pick(F.col("c_custkey") % 6, KINDS)).alias("account_label"),
        T.cents(F.col("c_acctbal")).alias("amount_cents"), F.lit("2026-01-01").cast("date").alias("date"),
        F.lit(None).cast("string").alias("duplicate_of"))


@REG.query("guess_account_type", f"""SELECT DISTINCT label, {sql_first_match('label', R.ACCOUNT_TYPES, '(?i)', "'checking'")} AS account_type FROM (SELECT {LABEL_SQL} AS label FROM customer)""")
def guess_account_type(spark, sf):
    return label_rows(spark, sf).select(F.col("account_label").alias("label"), I.guess_account_type(F.col("account_label")).alias("account_type")).distinct()


RESOLVED = f"""WITH r AS (SELECT c_custkey AS line_no, {LABEL_SQL} AS account_label, CAST(round(c_acctbal*100) AS BIGINT) AS amount_cents FROM customer),
al AS (SELECT DISTINCT account_label, CASE WHEN account_label LIKE '%Visa' THEN 'A-'||account_label END AS a, true AS seen FROM r WHERE account_label LIKE '%Visa' OR account_label LIKE '%cash box'),
ac AS (SELECT DISTINCT lower(account_label) AS low, 'B-'||account_label AS b FROM r WHERE account_label LIKE '%Savings'),
x AS (SELECT r.*, CASE WHEN seen THEN a ELSE b END AS account_id, CASE WHEN (CASE WHEN seen THEN a ELSE b END) IS NOT NULL THEN 'mapped' WHEN seen THEN 'skipped' ELSE 'needs_account' END AS account_status
 FROM r LEFT JOIN al USING (account_label) LEFT JOIN ac ON low=lower(account_label))"""


def resolved_rows(spark, sf):
    rows = label_rows(spark, sf)
    names = rows.select("account_label").distinct()
    aliases = names.filter(F.col("account_label").rlike("(Visa|cash box)$")).select(
        F.col("account_label").alias("label"), F.when(F.col("account_label").endswith("Visa"), F.concat(F.lit("A-"), "account_label")).alias("account_id"))
    accounts = names.filter(F.col("account_label").endswith("Savings")).select(
        F.concat(F.lit("B-"), "account_label").alias("account_id"), F.concat(F.lit(" "), F.upper("account_label")).alias("name"))
    return I.resolve_accounts(rows, aliases, accounts)


@REG.query("resolve_accounts", f"{RESOLVED} SELECT line_no, account_id, account_status FROM x")
def resolve_accounts(spark, sf):
    return resolved_rows(spark, sf).select("line_no", "account_id", "account_status")


@REG.query("account_summary", f"""{RESOLVED} SELECT account_label, count(*) AS rows, DATE '2026-01-01' AS from_date, DATE '2026-01-01' AS to_date, 0 AS duplicates,
 CAST(sum(amount_cents) AS BIGINT) AS net_cents, max(account_status) AS status, {sql_first_match('account_label', R.ACCOUNT_TYPES, '(?i)', "'checking'")} AS suggested_type FROM x GROUP BY account_label""")
def account_summary(spark, sf):
    return I.account_summary(resolved_rows(spark, sf))


BANK = f"""
v_bank AS (SELECT 'O'||CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS line_no, 'u'||CAST(o_custkey%10 AS VARCHAR) AS user_id, CAST(o_orderdate AS DATE) AS date,
 replace({sql_pick(f'o_orderkey%{len(T.WORDINGS)}', T.WORDINGS)}, '{{n}}', CAST(o_custkey AS VARCHAR)) AS description,
 CAST(round(o_totalprice*100) AS BIGINT)*CASE WHEN o_orderstatus='O' THEN 1 ELSE -1 END AS amount_cents,
 {sql_pick(f'o_custkey%{len(T.LABELS)}', T.LABELS)} AS source_label, CASE WHEN o_custkey%5=0 THEN 'credit_card' ELSE 'checking' END AS account_type FROM orders)
"""


def merchant_sql(source: str, text: str, out: str) -> str:
    """CTEs that add ``merchant`` to ``source``."""
    upper_words = ", ".join(sql_text(w) for w in R.KEEP_UPPER)
    brands = sql_first_match("s0", R.BRANDS[1:])
    return f"""
{out}_a AS (SELECT *, trim(regexp_replace(upper({text}),'\\s+',' ','g')) AS s0 FROM {source}),
{out}_b AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(s0,{sql_text(R.PRIME)},'~','g'),{sql_text(R.BRANDS[0][0])}) THEN 'Amazon' ELSE {brands} END AS brand,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s0,{sql_text(M.PREFIX)},''),{sql_text(R.PROCESSOR)},''),{sql_text(M.NOISE_ANY)},' ','g'),{sql_text("[^A-Z0-9&'.+" + chr(92) + "- ]")},' ','g'),'\\s+',' ','g'),' -.') AS s5 FROM {out}_a),
{out}_c AS (SELECT *, CASE WHEN len(string_split(s5,' '))>=3 THEN trim(regexp_replace(s5,{sql_text(M.CITY_STATE)},'\\1'),' -.') ELSE s5 END AS s6 FROM {out}_b),
{out}_d AS (SELECT *, trim(regexp_replace(s6,{sql_text(M.BARE_STATE)},'\\1'),' -.') AS s7 FROM {out}_c),
{out}_e AS (SELECT *, array_to_string(list_transform(list_filter(string_split(s7,' '), lambda w: w<>'')[1:5], lambda w: CASE WHEN w IN ({upper_words}) THEN w ELSE upper(left(w,1))||lower(substr(w,2)) END),' ') AS named,
 array_to_string(list_transform(regexp_extract_all(left(s0,40),'([A-Z]+|[^A-Z]+)'), lambda w: upper(left(w,1))||lower(substr(w,2))),'') AS titled FROM {out}_d),
{out} AS (SELECT *, CASE WHEN s0='' THEN 'Unknown' ELSE coalesce(brand, CASE WHEN named<>'' THEN left(named,120) END, titled) END AS merchant FROM {out}_e)"""


def with_merchant(spark, sf):
    return T.bank_lines(spark, sf).withColumn("merchant", M.normalize_merchant(F.col("description")))


@REG.query("normalize_text", f"WITH {BANK} SELECT id, trim(regexp_replace(upper(description||'  x'),'\\s+',' ','g')) AS text FROM v_bank")
def normalize_text(spark, sf):
    return T.bank_lines(spark, sf).select("id", M.normalize_text(F.concat("description", F.lit("  x"))).alias("text"))


@REG.query("normalize_merchant", f"WITH {BANK}, {merchant_sql('v_bank', 'description', 'm')} SELECT id, merchant FROM m")
def normalize_merchant(spark, sf):
    return with_merchant(spark, sf).select("id", "merchant")


TIDY = f"""WITH {BANK}, {merchant_sql('v_bank', 'description', 'm')},
t AS (SELECT id, trim(regexp_replace(description,'\\s+',' ','g')) AS p, merchant FROM m),
u AS (SELECT id, p, CASE WHEN regexp_matches(upper(p),{sql_text(R.RAW_HINT)}) OR (p=upper(p) AND p<>lower(p) AND length(p)>12) THEN merchant ELSE p END AS name FROM t),
w AS (SELECT *, list_filter(string_split(name,' '), lambda x: x<>'') AS w FROM u),
h AS (SELECT *, list_max(list_filter(range(1, CAST(len(w)//2 AS BIGINT)+1), lambda n: w[1:n]=w[n+1:2*n])) AS hit FROM w)
SELECT id, CASE WHEN p='' THEN 'Unknown' WHEN hit IS NULL THEN name ELSE array_to_string(list_concat(w[1:hit], w[2*hit+1:len(w)]),' ') END AS payee FROM h"""


@REG.query("tidy_payee", TIDY)
def tidy_payee(spark, sf):
    return T.bank_lines(spark, sf).select("id", M.tidy_payee(F.col("description")).alias("payee"))


USER_RULES_SQL = """
v_rules AS (SELECT 'u'||CAST(u AS VARCHAR) AS user_id, 'r'||CAST(k AS VARCHAR) AS rule_id, CASE WHEN k=0 THEN 'merchant_exact' ELSE 'contains' END AS match_type,
 CASE WHEN k=0 THEN 'STARBUCKS' ELSE 'COLUMBUS' END AS pattern, CASE WHEN k=0 THEN 'Dining & Coffee' ELSE 'Travel' END AS category,
 k*(CASE WHEN u=4 THEN 5 ELSE 1 END) AS age FROM (SELECT DISTINCT c_custkey%10 AS u FROM customer WHERE (c_custkey%10)%2=0), (SELECT unnest([0,1]) AS k))
"""
USER_HIT = f"""WITH {BANK}, {merchant_sql('v_bank', 'description', 'm')}, {USER_RULES_SQL},
uh AS (SELECT id, arg_max(category, (age, rule_id)) AS user_category FROM m JOIN v_rules r ON r.user_id=m.user_id AND
 ((match_type='merchant_exact' AND upper(merchant)=pattern) OR (match_type='contains' AND contains(upper(description),pattern))) GROUP BY id),
mu AS (SELECT m.*, user_category FROM m LEFT JOIN uh USING (id))"""


@REG.query("apply_user_rules", f"{USER_HIT} SELECT id, user_category FROM mu")
def apply_user_rules(spark, sf):
    return G.apply_user_rules(with_merchant(spark, sf), T.user_rules(spark, sf)).select("id", "user_category")


def builtin_sql() -> str:
    whens = []
    for p, cat, sign in R.BUILTIN_RULES:
        gate = {0: "true", 1: "amount_cents>0", -1: "amount_cents<=0"}[sign]
        whens.append(f"WHEN {gate} AND (regexp_matches(upper(description),{sql_text(p)}) OR regexp_matches(upper(merchant),{sql_text(p)})) THEN {sql_text(cat)}")
    return "CASE " + " ".join(whens) + " END"


KIND = "CASE " + " ".join(f"WHEN category={sql_text(n)} THEN '{k}'" for n, k, _ in R.BUILTIN_CATEGORIES) + " END"
DIRECTION = """CASE WHEN kind IS NULL THEN CASE WHEN amount_cents>0 THEN 'income' ELSE 'expense' END WHEN kind='transfer' THEN 'transfer'
 WHEN kind='income' THEN CASE WHEN amount_cents>=0 THEN 'income' ELSE 'expense' END ELSE 'expense' END"""
FALLBACK = """CASE WHEN amount_cents>0 AND account_type='credit_card' THEN 'Credit Card Payment' WHEN amount_cents>0 THEN 'Other Income' ELSE 'Uncategorized' END"""
FALLBACK_CONF = "CASE WHEN amount_cents>0 AND account_type='credit_card' THEN 0.5 WHEN amount_cents>0 THEN 0.4 ELSE 0.0 END"


@REG.query("categorize", f"""{USER_HIT}, b AS (SELECT *, {builtin_sql()} AS rule_category FROM mu),
c AS (SELECT *, coalesce(user_category, rule_category, {FALLBACK}) AS category,
 CASE WHEN user_category IS NOT NULL THEN 'user_rule' WHEN rule_category IS NOT NULL OR amount_cents>0 THEN 'rule' ELSE 'none' END AS category_source,
 CAST(CASE WHEN user_category IS NOT NULL THEN 0.99 WHEN rule_category IS NOT NULL THEN 0.8 ELSE {FALLBACK_CONF} END AS DOUBLE) AS confidence FROM b),
k AS (SELECT *, {KIND} AS kind FROM c) SELECT id, category, category_source, confidence, {DIRECTION} AS direction FROM k""")
def categorize(spark, sf):
    return G.categorize(with_merchant(spark, sf), T.user_rules(spark, sf)).select("id", "category", "category_source", "confidence", "direction")


GROUP_KIND = "CASE " + " ".join(f"WHEN g={sql_text(n)} THEN '{k}'" for n, k, _ in R.BUILTIN_CATEGORIES) + " END"
LABEL_KIND = f"""CASE WHEN regexp_matches(source_label,{sql_text('(?i)' + R.TRANSFER_HINT)}) OR coalesce({GROUP_KIND},'')='transfer' THEN 'transfer'
 WHEN regexp_matches(source_label,{sql_text('(?i)' + R.INCOME_HINT)}) OR coalesce({GROUP_KIND},'')='income' THEN 'income' ELSE 'expense' END"""


@REG.query("categorize_imported", f"""{USER_HIT}, b AS (SELECT *, {builtin_sql()} AS rule_category, {sql_first_match('source_label', R.SOURCE_GROUPS, '(?i)')} AS g,
 CASE WHEN lower(source_label) NOT IN ('','uncategorized','uncategorised','none') THEN source_label END AS label,
 (regexp_matches(merchant,{sql_text('(?i)' + R.OWN_TRANSFER)}) OR regexp_matches(description,{sql_text('(?i)' + R.OWN_TRANSFER)})) AS own FROM mu),
c AS (SELECT *, {LABEL_KIND} AS label_kind, coalesce(user_category, label, CASE WHEN own THEN 'Transfer' END, rule_category, {FALLBACK}) AS category,
 CASE WHEN user_category IS NOT NULL THEN 'user_rule' WHEN label IS NOT NULL THEN 'import' WHEN own OR rule_category IS NOT NULL OR amount_cents>0 THEN 'rule' ELSE 'none' END AS category_source,
 CAST(CASE WHEN user_category IS NOT NULL THEN 0.99 WHEN label IS NOT NULL THEN 0.95 WHEN own THEN 0.9 WHEN rule_category IS NOT NULL THEN 0.8 ELSE {FALLBACK_CONF} END AS DOUBLE) AS confidence FROM b),
k AS (SELECT *, coalesce({KIND}, label_kind) AS kind FROM c) SELECT id, category, category_source, confidence, {DIRECTION} AS direction FROM k""")
def categorize_imported(spark, sf):
    return G.categorize_imported(with_merchant(spark, sf), T.user_rules(spark, sf)).select(
        "id", "category", "category_source", "confidence", "direction")


@REG.query("recategorize", f"""WITH {BANK}, {merchant_sql('v_bank', 'description', 'm')}, b AS (SELECT *, {builtin_sql()} AS rule_category FROM m),
c AS (SELECT *, CASE WHEN line_no%4=0 THEN 'Mine' ELSE coalesce(rule_category, {FALLBACK}) END AS category FROM b)
SELECT category, count(*) AS n FROM c GROUP BY 1""")
def recategorize(spark, sf):
    rows = with_merchant(spark, sf)
    own = F.col("line_no") % 4 == 0
    rows = rows.select("*", F.when(own, "Mine").otherwise("old").alias("category"), F.when(own, "user").otherwise("rule").alias("category_source"),
                       F.lit(1.0).alias("confidence"), F.lit("expense").alias("direction"))
    return G.recategorize(rows).groupBy("category").agg(F.count("*").alias("n"))


@REG.query("learn_correction", f"""WITH {BANK}, {merchant_sql('v_bank', 'description', 'm')},
s AS (SELECT *, CASE WHEN line_no%7=0 THEN 'user' ELSE 'rule' END AS src, line_no%500=3 AS fix FROM m),
t AS (SELECT DISTINCT user_id, merchant, true AS taught FROM s WHERE fix)
SELECT s.id, CASE WHEN fix OR (coalesce(taught,false) AND src<>'user') THEN 'Pets' ELSE 'old' END AS category,
 CASE WHEN fix THEN 'user' WHEN coalesce(taught,false) AND src<>'user' THEN 'user_rule' ELSE src END AS category_source FROM s LEFT JOIN t USING (user_id, merchant)""")
def learn_correction(spark, sf):
    rows = with_merchant(spark, sf).select(
        "*", F.lit("old").alias("category"), F.when(F.col("line_no") % 7 == 0, "user").otherwise("rule").alias("category_source"),
        F.lit(0.8).alias("confidence"), F.lit("expense").alias("direction"))
    fixes = rows.filter(F.col("line_no") % 500 == 3).select("user_id", "id", F.lit("Pets").alias("category"), F.lit("expense").alias("kind"))
    return G.learn_correction(rows, T.user_rules(spark, sf), fixes)["transactions"].select("id", "category", "category_source")


@REG.query("source_fixes", f"""WITH {BANK}, {merchant_sql('v_bank', 'description', 'm')}, b AS (SELECT *, {builtin_sql()} AS rule_category,
 CASE WHEN lower(source_label) NOT IN ('','uncategorized','uncategorised','none') THEN source_label END AS label,
 (regexp_matches(merchant,{sql_text('(?i)' + R.OWN_TRANSFER)}) OR regexp_matches(description,{sql_text('(?i)' + R.OWN_TRANSFER)})) AS own FROM m)
SELECT id, CASE WHEN line_no%4=0 THEN 'Mine' ELSE coalesce(label, CASE WHEN own THEN 'Transfer' END, rule_category, {FALLBACK}) END AS category FROM b""")
def source_fixes(spark, sf):
    rows = with_merchant(spark, sf)
    own = F.col("line_no") % 4 == 0
    rows = rows.select("*", F.when(own, "Mine").otherwise("old").alias("category"), F.when(own, "user").otherwise("rule").alias("category_source"),
                       F.lit(1.0).alias("confidence"), F.lit("expense").alias("direction"))
    return G.apply_fixes({"transactions": rows}, 3)["transactions"].select("id", "category")


NODES = f"""WITH {BANK}, l AS (SELECT DISTINCT source_label AS label FROM v_bank),
p AS (SELECT CASE WHEN len(x)=0 THEN ['Uncategorized'] ELSE x[1:4] END AS parts FROM (SELECT list_filter(list_transform(string_split(label,':'), lambda s: left(trim(s),60)), lambda s: s<>'') AS x FROM l)),
n AS (SELECT unnest(range(1,len(parts)+1)) AS depth, parts FROM p),
f AS (SELECT depth, parts[depth] AS name, array_to_string(parts[1:depth],':') AS path, depth=len(parts) AS leaf,
 CASE WHEN depth>1 THEN sha256(lower(array_to_string(parts[1:depth-1],':'))) END AS parent_id FROM n),
g AS (SELECT *, CASE WHEN leaf THEN {sql_first_match('path', R.SOURCE_GROUPS, '(?i)')} ELSE {sql_first_match('name', R.SOURCE_GROUPS, '(?i)')} END AS g, path AS source_label FROM f)"""


@REG.query("category_tree_from_labels", f"""{NODES}
SELECT sha256(lower(path)) AS id, first(parent_id) AS parent_id, first(name) AS name, first(path) AS path, arg_min(g, NOT leaf) AS "group",
 arg_min({LABEL_KIND}, NOT leaf) AS kind FROM g GROUP BY lower(path)""")
def category_tree_from_labels(spark, sf):
    labels = T.bank_lines(spark, sf).select(F.col("source_label").alias("label"))
    return C.build_category_tree(labels).select("id", "parent_id", "name", "path", "group", "kind")


@REG.query("direction", f"""WITH {BANK}, k AS (SELECT id, amount_cents, CASE line_no%4 WHEN 0 THEN 'transfer' WHEN 1 THEN 'income' WHEN 2 THEN 'expense' END AS kind FROM v_bank)
SELECT id, {DIRECTION} AS direction FROM k""")
def direction(spark, sf):
    rows = T.bank_lines(spark, sf)
    kind = T.pick(F.col("line_no") % 4, ["transfer", "income", "expense", ""])
    return rows.select("id", C.direction(F.when(kind != "", kind), F.col("amount_cents")).alias("direction"))
