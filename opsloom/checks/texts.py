"""Registered corpus, rule-set and question queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsloom.checks.insights import PAYMENTS
from opsloom.checks.registry import Registry, sql_first_match, sql_pick, sql_ratio, sql_text
from opsloom.checks.views import CATEGORIES, LEDGER
from opsloom.functions import markup as H
from opsloom.operators import corpus as X
from opsloom.operators import questions as N
from opsloom.operators import rulesets as R
from opsloom.operators import summaries as Q
from opsloom.session import shared_folder
from opsloom.sources import filters_xml as FX
from opsloom.sources import tables as T
from opsloom.functions.linediff import apply_hunks

REG = Registry()

RULE_LINES = [
    "# private things", "", r"regex:[A-Za-z0-9._-]+@mail\d\.example\.com==>[mail]", 'token = "==>token = "#', "literal:Nicht aulich", "glob:token ?[0-9a-c]*d",
    "glob:Ascirr*óciónta", "user token", "the thing==>the thing!",
]
RULES = X.compile_rules(RULE_LINES)
LABELS = [r.label for r in RULES]
# each rule as SQL: exact test, test in any case
def _exact(col):
    return [f"regexp_matches({col},'[A-Za-z0-9._-]+@mail\\d\\.example\\.com')", f"contains({col},'token = \"')", f"contains({col},'Nicht aulich')",
            f"regexp_matches({col},'(?s)token .[0-9a-c].*d')", f"regexp_matches({col},'(?s)Ascirr.*óciónta')", f"contains({col},'user token')", f"contains({col},'the thing')"]


def _any(col):
    return [_exact(col)[0], f"contains(lower({col}),'token = \"')", f"contains(lower({col}),'nicht aulich')",
            f"regexp_matches({col},'(?is)token .[0-9a-c].*d')", f"regexp_matches({col},'(?is)Ascirr.*óciónta')", f"contains(lower({col}),'user token')", f"contains(lower({col}),'the thing')"]


N_RULES = range(len(RULES))
DOCS = "docs AS (SELECT doc_id, source||'/'||lang||'/'||CAST(doc_id%97 AS VARCHAR) AS path, text FROM documents)"


def items_sql(source: str, out: str) -> str:
    e, a = _exact("text"), _any("text")
    cols = ", ".join(f"{e[i]} AS e{i}, {'false' if RULES[i].kind == 'regex' else a[i] + ' AND NOT ' + e[i]} AS n{i}" for i in N_RULES)
    return f"{out} AS (SELECT DISTINCT ON (sha256(text)) path, {cols} FROM {source} ORDER BY sha256(text), doc_id)"


def scan_sql(items: str, messages: str) -> str:
    e, a, b = _exact("message"), _any("author"), _any("committer")
    rows = " UNION ALL ".join(
        f"""SELECT {i} AS rule_ord, {sql_text(LABELS[i])} AS rule, (SELECT count(*) FROM {items} WHERE e{i}) AS blobs, (SELECT count(DISTINCT path) FROM {items} WHERE e{i}) AS paths,
 (SELECT count(DISTINCT path) FROM {items} WHERE n{i}) AS near_misses, (SELECT count(*) FROM {messages} WHERE {e[i]}) AS messages,
 (SELECT count(*) FROM (SELECT author AS x FROM {messages} WHERE {a[i]} UNION SELECT committer FROM {messages} WHERE {b[i]})) AS idents""" for i in N_RULES)
    return rows


MSGS = """msgs AS (SELECT conv_id, turn, 'User Token'||CAST(conv_id AS VARCHAR)||' <u'||CAST(conv_id AS VARCHAR)||'@mail.example.com>' AS author, role||' <'||role||'@mail5.example.com>' AS committer, text AS message FROM conversations)"""


def rule_lines(spark, sf):
    """The rules file's lines, one set per region."""
    lines = F.posexplode(F.array(*[F.lit(x) for x in RULE_LINES]))
    return T.table(spark, sf, "region").select("r_regionkey", lines.alias("i", "raw")).select((F.col("r_regionkey") * 100 + F.col("i") + 1).alias("line_no"), "raw")


@REG.query("corpus_parse_rules", f"""WITH l AS (SELECT r_regionkey*100+i AS line_no, (['{"','".join(x.replace("'", "''") for x in RULE_LINES)}'])[i] AS raw FROM region, range(1,{len(RULE_LINES) + 1}) t(i)),
k AS (SELECT *, CASE WHEN contains(raw,'==>') THEN left(raw, instr(raw,'==>')-1) ELSE raw END AS body, CASE WHEN contains(raw,'==>') THEN substr(raw, instr(raw,'==>')+3) ELSE '***REMOVED***' END AS replacement FROM l WHERE trim(raw)<>'' AND left(ltrim(raw),1)<>'#')
SELECT line_no, CASE WHEN body LIKE 'regex:%' THEN 'regex' WHEN body LIKE 'glob:%' THEN 'glob' ELSE 'literal' END AS kind, regexp_replace(body,'^(regex:|glob:|literal:)','') AS find, replacement FROM k""")
def corpus_parse_rules(spark, sf):
    return X.parse_rules(rule_lines(spark, sf)).select("line_no", "kind", "find", "replacement")


@REG.query("corpus_scan", f"WITH {DOCS}, {MSGS}, {items_sql('docs', 'it')} {scan_sql('it', 'msgs')}")
def corpus_scan(spark, sf):
    return X.scan(T.corpus(spark, sf), T.messages(spark, sf), RULES)


@REG.query("corpus_scan_paths", f"WITH {DOCS}, {items_sql('docs', 'it')}, p AS (" + " UNION ALL ".join(
    f"SELECT DISTINCT {i} AS rule_ord, path FROM it WHERE e{i}" for i in N_RULES) + ") SELECT rule_ord, row_number() OVER (PARTITION BY rule_ord ORDER BY path) AS n, path FROM p QUALIFY n<=25")
def corpus_scan_paths(spark, sf):
    return X.scan_paths(T.corpus(spark, sf), RULES)


@REG.query("corpus_total_hits", f"WITH {DOCS}, {MSGS}, {items_sql('docs', 'it')}, s AS ({scan_sql('it', 'msgs')}) SELECT CAST(sum(blobs+messages) AS BIGINT) AS total_hits FROM s")
def corpus_total_hits(spark, sf):
    return X.total_hits(X.scan(T.corpus(spark, sf), T.messages(spark, sf), RULES))


@REG.query("corpus_distinct_content", f"WITH {DOCS} SELECT sha256(text) AS sha, arg_min(path, doc_id) AS first_path, count(*) AS copies FROM docs GROUP BY 1")
def corpus_distinct_content(spark, sf):
    return X.distinct_content(T.corpus(spark, sf))


@REG.query("corpus_skip_binary", "SELECT doc_id, doc_id%10=0 AND doc_id%20<>0 AS binary FROM documents")
def corpus_skip_binary(spark, sf):
    zero = F.unhex(F.lit("00"))
    pad = F.repeat(F.lit("x"), 8000).cast("binary")
    d = T.table(spark, sf, "documents")
    body = F.when(F.col("doc_id") % 20 == 0, F.concat(pad, zero)).when(F.col("doc_id") % 10 == 0, F.concat(F.lit("a").cast("binary"), zero, F.col("text").cast("binary"))).otherwise(F.col("text").cast("binary"))
    return d.select("doc_id", X.is_binary(body).alias("binary"))


def rewrite_sql(col: str) -> str:
    t = f"regexp_replace({col},'[A-Za-z0-9._-]+@mail\\d\\.example\\.com','[mail]','g')"
    t = f"replace({t},'token = \"','token = \"#')"
    t = f"replace({t},'Nicht aulich','***REMOVED***')"
    t = f"regexp_replace({t},'(?s)token .[0-9a-c].*d','***REMOVED***','g')"
    t = f"regexp_replace({t},'(?s)Ascirr.*óciónta','***REMOVED***','g')"
    t = f"replace({t},'user token','***REMOVED***')"
    return f"replace({t},'the thing','the thing!')"


@REG.query("corpus_redact", f"SELECT doc_id, sha256({rewrite_sql('text')}) AS sha FROM documents")
def corpus_redact(spark, sf):
    return X.redact(T.corpus(spark, sf), RULES).select("doc_id", F.sha2("text", 256).alias("sha"))


@REG.query("corpus_verify_clean", f"""WITH docs AS (SELECT doc_id, source||'/'||lang||'/'||CAST(doc_id%97 AS VARCHAR) AS path, {rewrite_sql('text')} AS text FROM documents),
m0 AS (SELECT * FROM (SELECT 'User Token'||CAST(conv_id AS VARCHAR) AS author, role AS committer, {rewrite_sql('text')} AS message FROM conversations)),
{items_sql('docs', 'it')}, s AS ({scan_sql('it', 'm0')}) SELECT rule_ord, rule, messages+CASE WHEN rule_ord IN (1,6) THEN 0 ELSE blobs END AS "left", messages+CASE WHEN rule_ord IN (1,6) THEN 0 ELSE blobs END=0 AS clean FROM s""")
def corpus_verify_clean(spark, sf):
    docs = X.redact(T.corpus(spark, sf), RULES)
    return X.verify_clean(docs, X.redact(T.messages(spark, sf), RULES, "message"), RULES)


DIFF = f"""WITH d AS (SELECT doc_id, string_split(text,chr(10)) AS a, string_split({rewrite_sql('text')},chr(10)) AS b FROM documents),
x AS (SELECT doc_id, list_filter(list_distinct(a), lambda v: NOT list_contains(b,v)) AS removed, list_filter(list_distinct(b), lambda v: NOT list_contains(a,v)) AS added FROM d WHERE a<>b)
SELECT doc_id, len(removed) AS removed, len(added) AS added, sha256(array_to_string(list_sort(added),chr(10))) AS added_sha FROM x"""


@REG.query("corpus_preview_diff", DIFF)
def corpus_preview_diff(spark, sf):
    docs = T.corpus(spark, sf)
    return X.preview_diff(docs, X.redact(docs, RULES)).select(
        "doc_id", F.size("removed").alias("removed"), F.size("added").alias("added"), F.sha2(F.array_join(F.array_sort("added"), "\n"), 256).alias("added_sha"))


@REG.query("corpus_preview_rewrite", DIFF)
def corpus_preview_rewrite(spark, sf):
    return X.preview_rewrite(T.corpus(spark, sf), RULES).select(
        "doc_id", F.size("removed").alias("removed"), F.size("added").alias("added"), F.sha2(F.array_join(F.array_sort("added"), "\n"), 256).alias("added_sha"))


@REG.query("corpus_preview_hunks", f"""WITH d AS (SELECT doc_id, text AS o, {rewrite_sql('text')} AS t FROM documents)
SELECT doc_id, len(string_split(t,chr(10)))-len(string_split(o,chr(10))) AS grown, sha256(t) AS applied_sha, true AS lean FROM d WHERE o<>t""")
def corpus_preview_hunks(spark, sf):
    """Hunks applied to the old text give the new one; they add as many lines more than they take as the text grows; none is without a change."""
    docs = T.corpus(spark, sf)
    found = X.preview_hunks(docs, RULES).join(docs.select("doc_id", "text"), "doc_id")
    marked = lambda h, sign: F.filter(h["lines"], lambda x: F.substring(x, 1, 1) == sign)
    signed = lambda sign: F.size(F.flatten(F.transform("hunks", lambda h: marked(h, sign))))
    lean = F.forall("hunks", lambda h: F.size(marked(h, "-")) + F.size(marked(h, "+")) > 0)
    return found.select("doc_id", (signed("+") - signed("-")).cast("long").alias("grown"), F.sha2(apply_hunks(F.col("text"), F.col("hunks")), 256).alias("applied_sha"), lean.alias("lean"))


@REG.query("corpus_rules_digest", f"""WITH l AS (SELECT r_regionkey*100+i AS line_no, (['{"','".join(x.replace("'", "''") for x in RULE_LINES)}'])[i] AS raw FROM region, range(1,{len(RULE_LINES) + 1}) t(i))
SELECT sha256(string_agg(raw, chr(10) ORDER BY line_no)||chr(10)) AS rules_sha256 FROM l WHERE trim(raw)<>'' AND left(ltrim(raw),1)<>'#'""")
def corpus_rules_digest(spark, sf):
    return X.digest_of_lines(X.parse_rules(rule_lines(spark, sf)))


@REG.query("corpus_change_guard", """SELECT 'refs/'||CAST(doc_id AS VARCHAR) AS ref, CASE WHEN doc_id%100<>1 THEN sha256(text) END AS was, CASE WHEN doc_id%100<>2 THEN sha256(text||CASE WHEN doc_id%100=3 THEN 'x' ELSE '' END) END AS now
 FROM documents WHERE doc_id%100 IN (1,2,3)""")
def corpus_change_guard(spark, sf):
    d = T.table(spark, sf, "documents").withColumn("ref", F.concat(F.lit("refs/"), F.col("doc_id").cast("string")))
    n = F.col("doc_id") % 100
    marked = d.filter(n != 1).select("ref", F.sha2("text", 256).alias("sha"))
    live = d.filter(n != 2).select("ref", F.sha2(F.concat("text", F.when(n == 3, "x").otherwise("")), 256).alias("sha"))
    return X.change_guard(marked, live)


ENV = ["export API_TOKEN=abc=1", "HOME=/root", "# PASSWORD=x", "db_pass=", "KEY=1", "MONKEY=1", "no sign", "  my_key=9"]
YAML = ['  - DB_PASSWORD: "x y"', "token=abc", "name: web", "API_KEY : 5"]


@REG.query("redact_env", f"""WITH e AS (SELECT c_custkey AS k, {sql_pick('c_custkey%8', ENV)}||CAST(c_custkey AS VARCHAR) AS line, {sql_pick('c_custkey%4', YAML)} AS y FROM customer)
SELECT k, CASE WHEN contains(line,'=') AND NOT regexp_matches(line,'^\\s*#') AND regexp_matches(upper(regexp_replace(left(line,instr(line,'=')-1),'^\\s*(export\\s+)?','')),{sql_text(X.SECRET)})
 THEN left(line,instr(line,'='))||'<redacted>' ELSE line END AS env, regexp_replace(y,{sql_text(X.SECRET_YAML)},'\\1<redacted>') AS yaml FROM e""")
def redact_env(spark, sf):
    k = F.col("c_custkey")
    line = F.concat(T.pick(k % 8, ENV), k.cast("string"))
    return T.table(spark, sf, "customer").select(k.alias("k"), X.redact_env(line).alias("env"), X.redact_yaml(T.pick(k % 4, YAML)).alias("yaml"))


def _map(values) -> str:
    return "MAP {" + ",".join(f"{sql_text(k)}:{sql_text(v)}" for k, v in values.items()) + "}"


def unescape_sql(col: str) -> str:
    """One reference at a time, as the column expression does."""
    piece = f"""CASE WHEN ({_map(H.ENTITIES)})[regexp_extract(p,{sql_text(H.NAMED)},1)] IS NOT NULL AND regexp_matches(p,{sql_text(H.NAMED)}) THEN ({_map(H.ENTITIES)})[regexp_extract(p,{sql_text(H.NAMED)},1)]||substr(p,length(regexp_extract(p,{sql_text(H.NAMED)},1))+2)
 WHEN regexp_matches(p,{sql_text(H.BARE_PATTERN)}) THEN ({_map(H.BARE)})[regexp_extract(p,{sql_text(H.BARE_PATTERN)},1)]||substr(p,length(regexp_extract(p,{sql_text(H.BARE_PATTERN)},1))+1) ELSE '&'||p END"""
    return f"(string_split({col},'&')[1]||array_to_string(list_transform(string_split({col},'&')[2:], lambda p: {piece}),''))"


@REG.query("html_to_text", f"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,'(?i)<\\s*br\\s*/?\\s*>',chr(10),'g'),'(?i)</\\s*(p|div|li)\\s*>',chr(10),'g'),'<[^>]+>','','g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(replace({unescape_sql('t')},chr(160),' '),'[ \\t]+',' ','g'),'\\n{{3,}}',chr(10)||chr(10),'g') AS t FROM a)
SELECT page_id, regexp_replace(t,'^\\s+|\\s+$','','g') AS text FROM b""")
def html_to_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))


@REG.query("html_to_line", f"""WITH a AS (SELECT page_id, regexp_replace(html,'<[^>]+>',' ','g') AS t FROM pages),
b AS (SELECT page_id, trim(regexp_replace(replace({unescape_sql('t')},chr(160),' '),'\\s+',' ','g')) AS t FROM a) SELECT page_id, CASE WHEN length(t)>800 THEN left(t,800)||'…' ELSE t END AS line FROM b""")
def html_to_line(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", H.html_to_line(F.col("html")).alias("line"))


# --- filter rule sets ----------------------------------------------------------------------------------------------

K = "p_partkey"
FILTERS = f"""
f0 AS (SELECT 'f'||CAST({K} AS VARCHAR) AS id, {K}+1 AS pos, {K} AS k, [
 {{'key':'from','value':CASE WHEN {K}%7<>0 THEN p_brand ELSE '' END}}, {{'key':'to','value':CASE WHEN {K}%5=0 THEN 'false' ELSE '' END}}, {{'key':'subject','value':CASE WHEN {K}%3=0 THEN p_name ELSE '' END}},
 {{'key':'hasTheWord','value':CASE WHEN {K}%50=0 THEN repeat('word ',320) ELSE '' END}}, {{'key':'size','value':CASE WHEN {K}%11=0 THEN '10' ELSE '' END}}, {{'key':'sizeOperator','value':CASE WHEN {K}%22=0 THEN 's_sl' ELSE '' END}},
 {{'key':'sizeUnit','value':'s_smb'}}, {{'key':'label','value':CASE WHEN {K}%4<>0 THEN CASE WHEN {K}%9=0 THEN 'Infra/Alerts' WHEN {K}%9=1 THEN 'Infra' ELSE p_type END ELSE '' END}},
 {{'key':'shouldTrash','value':CASE WHEN {K}%6=0 THEN 'true' ELSE '' END}}, {{'key':'shouldNeverSpam','value':CASE WHEN {K}%12=0 THEN 'true' ELSE '' END}}, {{'key':'shouldStar','value':'false'}},
 {{'key':'shouldAlwaysMarkAsImportant','value':CASE WHEN {K}%13=0 THEN 'true' ELSE '' END}}, {{'key':'shouldNeverMarkAsImportant','value':CASE WHEN {K}%26=0 THEN 'true' ELSE '' END}},
 {{'key':'someFutureAction','value':CASE WHEN {K}%17=0 THEN 'x' ELSE '' END}}] AS props FROM part),
f1 AS (SELECT *, list_filter(props, lambda e: e.value<>'' AND lower(e.value)<>'false') AS c FROM f0),
f2 AS (SELECT *, list_transform(c, lambda e: e.key) AS ks, array_to_string(list_sort(list_transform(c, lambda e: e.key||'='||e.value)),';') AS canon FROM f1),
f3 AS (SELECT *, NOT (list_has_any(ks,['from','to','subject','hasTheWord','doesNotHaveTheWord','size','hasAttachment'])) AS p1,
 len(list_filter(ks, lambda x: x NOT IN ('from','to','subject','hasTheWord','doesNotHaveTheWord','size','hasAttachment','sizeOperator','sizeUnit','excludeChats')))=0 AS p2,
 coalesce(list_sum(list_transform(list_filter(c, lambda e: e.key IN ('from','to','subject','hasTheWord','doesNotHaveTheWord')), lambda e: length(e.value))),0)>1500 AS p3,
 count(*) OVER (PARTITION BY canon) AS copies FROM f2),
f4 AS (SELECT *, list_filter([CASE WHEN p1 THEN 'no criteria' END, CASE WHEN p2 THEN 'no action' END, CASE WHEN p3 THEN 'criteria over 1500 characters' END], lambda x: x IS NOT NULL) AS problems FROM f3),
f5 AS (SELECT *, list_concat(problems, list_filter([CASE WHEN list_has_all(ks,['shouldTrash','shouldNeverSpam']) THEN 'delete and never spam' END,
 CASE WHEN list_has_all(ks,['shouldAlwaysMarkAsImportant','shouldNeverMarkAsImportant']) THEN 'important both ways' END,
 CASE WHEN list_contains(ks,'size') AND NOT list_has_all(ks,['sizeOperator','sizeUnit']) THEN 'size without operator or unit' END, CASE WHEN copies>1 THEN 'exact duplicate' END], lambda x: x IS NOT NULL)) AS warnings FROM f4)
"""


def flat(props):
    return F.array_join(F.array_sort(F.transform(F.map_entries(props), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


@REG.query("filters_read", f"WITH {FILTERS} SELECT pos, array_to_string(list_sort(list_transform(props, lambda e: e.key||'='||e.value)),';') AS props, CASE WHEN k%3=0 THEN 'subject' ELSE '' END AS clashes FROM f2")
def filters_read(spark, sf):
    """Property lists as the XML source delivers them, with a repeated property, made first-wins maps."""
    base = T.filters(spark, sf)
    as_list = F.transform(F.map_entries("props"), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("_value")))
    again = F.array(F.struct(F.lit("subject").alias("_name"), F.when((F.col("pos") - 1) % 3 == 0, "other").otherwise(F.col("props")["subject"]).alias("_value")),
                    F.struct(F.lit("").alias("_name"), F.lit("lost").alias("_value")))
    entries = base.select("pos", F.concat(as_list, again).alias("p"))
    return FX.from_properties(entries).select("pos", flat(F.col("props")).alias("props"), F.array_join("clashes", ",").alias("clashes"))


@REG.query("filters_clean_props", f"WITH {FILTERS} SELECT id, canon AS props FROM f2")
def filters_clean_props(spark, sf):
    return T.filters(spark, sf).select("id", flat(R.clean_props(F.col("props"))).alias("props"))


@REG.query("filters_merge", f"""WITH {FILTERS}, cur AS (SELECT DISTINCT canon FROM f2 WHERE k%4=0), nw AS (SELECT canon, min(pos) AS pos FROM f2 WHERE k%4<>0 AND canon NOT IN (SELECT canon FROM cur) GROUP BY 1),
b AS (SELECT max(pos) AS base FROM f2 WHERE k%4=0) SELECT id, pos FROM f2 WHERE k%4=0 UNION ALL SELECT f2.id, f2.pos+base FROM nw JOIN f2 ON f2.canon=nw.canon AND f2.pos=nw.pos, b""")
def filters_merge(spark, sf):
    all_filters = T.filters(spark, sf).withColumn("props", R.clean_props(F.col("props")))
    quarter = (F.col("pos") - 1) % 4 == 0
    return R.merge_filters(all_filters.filter(quarter), all_filters.filter(~quarter)).select("id", "pos")


@REG.query("filters_problems", f"WITH {FILTERS} SELECT id, array_to_string(problems,'|') AS problems FROM f4")
def filters_problems(spark, sf):
    return R.import_problems(T.filters(spark, sf)).select("id", F.array_join("problems", "|").alias("problems"))


@REG.query("filters_warnings", f"WITH {FILTERS} SELECT id, array_to_string(warnings,'|') AS warnings, copies FROM f5")
def filters_warnings(spark, sf):
    return R.conflict_warnings(T.filters(spark, sf)).select("id", F.array_join("warnings", "|").alias("warnings"), "copies")


@REG.query("filters_rename_label", f"""WITH {FILTERS}, l AS (SELECT id, list_filter(props, lambda e: e.key='label')[1].value AS v FROM f0)
SELECT id, CASE WHEN v='Infra' THEN 'Ops' WHEN v LIKE 'Infra/%' THEN 'Ops'||substr(v,6) ELSE v END AS label FROM l""")
def filters_rename_label(spark, sf):
    return R.rename_label(T.filters(spark, sf), "Infra", "Ops", nested=True).select("id", F.col("props")["label"].alias("label"))


@REG.query("filters_search", f"""WITH {FILTERS} SELECT id, len(warnings) AS n FROM f5 WHERE len(warnings)>0 AND len(list_filter(props, lambda e: contains(lower(e.key||' '||e.value),'subject red')))>0""")
def filters_search(spark, sf):
    return R.search_filters(T.filters(spark, sf), "subject RED", "warn", sort="label").select("id", F.size("warnings").alias("n"))


@REG.query("filters_export", f"""WITH {FILTERS} SELECT id, array_to_string(list_transform(list_sort(list_transform(c, lambda e: lpad(CAST(CASE WHEN list_position({R.PROPERTY_ORDER!r}, e.key)>0 THEN list_position({R.PROPERTY_ORDER!r}, e.key) ELSE 22 END AS VARCHAR),3,'0')||e.key||'='||e.value)), lambda x: substr(x,4)),';') AS properties FROM f4 WHERE len(problems)=0""")
def filters_export(spark, sf):
    good, _ = R.export_filters(T.filters(spark, sf))
    return good.select("id", F.array_join(F.transform("properties", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("properties"))


@REG.query("filters_export_counts", f"WITH {FILTERS} SELECT count(*) FILTER (len(problems)=0) AS exported, count(*) FILTER (len(problems)>0) AS skipped FROM f4")
def filters_export_counts(spark, sf):
    return R.export_counts(T.filters(spark, sf))


@REG.query("filters_feed", f"WITH {FILTERS} SELECT array_to_string(list_sort(list_transform(c, lambda e: e.key||'='||e.value)),';') AS props, '' AS clashes FROM f4 WHERE len(problems)=0")
def filters_feed(spark, sf):
    """The filters that can be exported, written as feeds and read back."""
    folder = shared_folder(spark, "feeds")
    FX.write_filters(R.import_problems(T.filters(spark, sf)).filter(F.size("problems") == 0), folder)
    return FX.read_filters(spark, folder).select(flat(F.col("props")).alias("props"), F.array_join("clashes", ",").alias("clashes"))


# --- questions ---------------------------------------------------------------------------------------------------------

ASK = f"""qs AS (SELECT conv_id*1000+turn AS question_id, {sql_pick(f'(conv_id*1000+turn)%{len(T.ASKED)}', T.ASKED)}||' / '||text AS question FROM conversations WHERE role='user'),
ql AS (SELECT *, lower(question) AS q, lower(trim(question)) AS q5 FROM qs)"""
NAMES = ["ECONOMY", "Goods", "LARGE", "SMALL", "Transfer"]
WORDED = "CASE " + " ".join(f"WHEN regexp_matches(q,{sql_text(chr(92) + 'b(' + '|'.join(w) + ')' + chr(92) + 'b')}) THEN {sql_text(c)}" for c, w in N.CATEGORY_WORDS.items()) + " END"
ENTITY = f"""{ASK}, br AS (SELECT DISTINCT p_brand AS merchant, lower(p_brand) AS low FROM part),
em AS (SELECT question_id, arg_max(merchant, length(merchant)) AS merchant FROM ql JOIN br ON regexp_matches(q, '(^|[^\\pL\\pN_])'||replace(low,'#','\\#')||'($|[^\\pL\\pN_])') GROUP BY 1),
ec AS (SELECT ql.*, merchant, coalesce(CASE {' '.join(f"WHEN contains(q,'{n.lower()}') THEN '{n}'" for n in NAMES[:-1])} END, {WORDED}) AS category FROM ql LEFT JOIN em USING (question_id))"""


def asked(spark, sf):
    brands = T.table(spark, sf, "part").select(F.col("p_brand").alias("merchant"))
    found = N.find_entities(T.questions(spark, sf), brands)
    return found.withColumn("category", N.find_category(F.col("question"), F.array(*[F.lit(n) for n in NAMES])))


@REG.query("question_entities", f"WITH {ENTITY} SELECT question_id, merchant, category FROM ec")
def question_entities(spark, sf):
    return asked(spark, sf).select("question_id", "merchant", "category")


@REG.query("question_intent", f"""WITH {ENTITY} SELECT question_id, CASE WHEN (merchant IS NOT NULL OR category IS NOT NULL) AND regexp_matches(q5,{sql_text(N.SPEND)}) THEN 'spend'
 ELSE coalesce({sql_first_match('q5', N.INTENTS)}, CASE WHEN regexp_matches(q5,{sql_text(N.OVERVIEW)}) THEN 'overview' END, 'help') END AS intent FROM ec""")
def question_intent(spark, sf):
    names = F.col("merchant").isNotNull() | F.col("category").isNotNull()
    return asked(spark, sf).select("question_id", N.route_intent(F.col("question"), names).alias("intent"))


TODAY, LATEST = dt.date(2024, 6, 12), dt.date(2001, 8, 15)
MONTH_NO = "CASE mn " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in N.MONTHS.items()) + " END"
PERIOD = f"""{ASK}, p0 AS (SELECT *, regexp_extract(q,'last (\\d{{1,2}}) months',1) AS n, regexp_extract(q,{sql_text(N.MONTH_PATTERN)},1) AS mn, regexp_extract(q,{sql_text(N.MONTH_PATTERN)},2) AS my, regexp_extract(q,'\\b(in|during|for) (\\d{{4}})\\b',2) AS iy FROM ql),
p1 AS (SELECT *, {MONTH_NO} AS m FROM p0), p2 AS (SELECT *, make_date(CASE WHEN my<>'' THEN CAST(NULLIF(my,'') AS INTEGER) WHEN m<=6 THEN 2024 ELSE 2023 END, m, 1) AS ms FROM p1),
p3 AS (SELECT *, CASE WHEN contains(q,'last month') OR contains(q,'previous month') THEN 1 WHEN contains(q,'this month') THEN 2 WHEN contains(q,'last year') THEN 3 WHEN contains(q,'this year') OR contains(q,'ytd') OR contains(q,'year to date') THEN 4
 WHEN n<>'' THEN 5 WHEN mn<>'' AND NOT (mn='may' AND my='' AND regexp_matches(q,'\\bmay (i|we)\\b')) THEN 6 WHEN iy<>'' THEN 7 ELSE 8 END AS c FROM p2),
pd AS (SELECT question_id, c<>8 AS explicit, CAST(CASE c WHEN 1 THEN DATE '2024-05-01' WHEN 2 THEN DATE '2024-06-01' WHEN 3 THEN DATE '2023-01-01' WHEN 4 THEN DATE '2024-01-01' WHEN 5 THEN DATE '2024-06-01'-to_months(CAST(NULLIF(n,'') AS INTEGER)) WHEN 6 THEN ms WHEN 7 THEN make_date(CAST(NULLIF(iy,'') AS INTEGER),1,1) ELSE DATE '2001-08-01' END AS DATE) AS period_start,
 CAST(CASE c WHEN 1 THEN DATE '2024-05-31' WHEN 2 THEN DATE '2024-06-12' WHEN 3 THEN DATE '2023-12-31' WHEN 4 THEN DATE '2024-06-12' WHEN 5 THEN DATE '2024-05-31' WHEN 6 THEN last_day(ms) WHEN 7 THEN make_date(CAST(NULLIF(iy,'') AS INTEGER),12,31) ELSE DATE '2001-08-31' END AS DATE) AS period_end FROM p3)"""


PERIOD_ONLY = "p0 AS" + PERIOD.split(", p0 AS", 1)[1]


@REG.query("question_period", f"WITH {PERIOD} SELECT * FROM pd")
def question_period(spark, sf):
    return N.extract_period(T.questions(spark, sf), F.lit(TODAY), F.lit(LATEST)).select("question_id", "period_start", "period_end", "explicit")


@REG.query("question_grounded", f"""WITH {ASK}, n AS (SELECT question_id, list_transform(list_filter(list_transform(regexp_extract_all(question||' 1,250.50 12%','(^|[^A-Za-z])(-?\\$?\\d[\\d,]*(?:\\.\\d+)?%?)',2), lambda x: regexp_replace(x,'[$,%-]','','g')), lambda x: x<>''), lambda x: CAST(x AS DECIMAL(36,2))) AS u FROM qs)
SELECT question_id, len(list_filter(u, lambda x: x NOT IN (1250.50, 12.00, 3.00, 2000.00, 7.00)))=0 AS grounded FROM n""")
def question_grounded(spark, sf):
    source = F.lit("We saw $1,250.50 (12%) over 3 months in 2000 for no 7")
    return T.questions(spark, sf).select("question_id", N.grounded(F.concat("question", F.lit(" 1,250.50 12%")), source).alias("grounded"))


@REG.query("spend_answers", f"""WITH {ENTITY}, {PERIOD_ONLY}, {LEDGER},
e AS (SELECT date, merchant, category_id, amount_cents FROM v_ledger WHERE direction='expense'),
q1 AS (SELECT ec.question_id, merchant AS qm, category AS qc, period_start, period_end FROM ec JOIN pd USING (question_id)),
h AS (SELECT question_id, e.* FROM q1 JOIN e ON date BETWEEN period_start AND period_end AND (CASE WHEN qm IS NOT NULL THEN e.merchant=qm ELSE e.category_id=qc END)),
g AS (SELECT question_id, CAST(-sum(amount_cents) AS BIGINT) AS total_cents, count(*) AS count, CAST(sum(CASE WHEN amount_cents>0 THEN amount_cents ELSE 0 END) AS BIGINT) AS refund_cents FROM h GROUP BY 1),
b AS (SELECT question_id, -amount_cents AS largest_cents, merchant AS largest_merchant, date AS largest_date FROM h QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY amount_cents, merchant, date)=1),
w AS (SELECT period_start, period_end, CAST(-sum(amount_cents) AS BIGINT) AS alls FROM (SELECT DISTINCT period_start, period_end FROM q1) JOIN e ON date BETWEEN period_start AND period_end GROUP BY 1,2),
s AS (SELECT DISTINCT period_start, period_end FROM (SELECT DISTINCT period_start, period_end FROM q1) WHERE EXISTS (SELECT 1 FROM v_ledger WHERE date BETWEEN period_start AND period_end)),
o AS (SELECT question_id, coalesce(total_cents,0) AS total_cents, coalesce(count,0) AS count, coalesce(refund_cents,0) AS refund_cents, coalesce(alls,0) AS alls, largest_cents, largest_merchant, largest_date,
 (period_start, period_end) IN (SELECT (period_start, period_end) FROM s) AS has_data FROM q1 LEFT JOIN g USING (question_id) LEFT JOIN b USING (question_id) LEFT JOIN w USING (period_start, period_end))
SELECT question_id, total_cents, count, refund_cents, {sql_ratio('total_cents', 'alls')} AS share_pct, largest_cents, largest_merchant, largest_date, has_data FROM o""")
def spend_answers(spark, sf):
    q = N.extract_period(asked(spark, sf), F.lit(TODAY), F.lit(LATEST)).withColumnRenamed("category", "category_id")
    return N.spend_answers(q, T.ledger(spark, sf))


@REG.query("spend_recommendations", f"""{PAYMENTS.rstrip()}, {LEDGER}, {CATEGORIES}, s AS (SELECT sum(CASE WHEN direction='income' THEN amount_cents ELSE 0 END) AS inc, sum(CASE WHEN direction='expense' THEN amount_cents ELSE 0 END) AS ex FROM v_ledger WHERE year(date)=1998),
b AS (SELECT coalesce(path,'Uncategorized') AS category, coalesce(essential,false) AS essential, CAST(-sum(amount_cents) AS BIGINT) AS a FROM v_ledger l LEFT JOIN v_path p ON p.id=l.category_id WHERE direction='expense' AND year(date)=1998 GROUP BY 1,2),
m AS (SELECT id, length(id)*100000000 AS lim, coalesce((SELECT -sum(amount_cents) FROM v_ledger WHERE direction='expense' AND category_id=c.id AND strftime(date,'%Y-%m')='1998-08'),0) AS sp FROM v_cat c WHERE kind='expense' AND parent_id IS NOT NULL)
SELECT 'low_savings_rate' AS kind, CAST(NULL AS VARCHAR) AS subject, CAST(inc+ex AS BIGINT) AS cents FROM s WHERE inc<>0 AND (inc+ex)*100.0/inc<10
UNION ALL SELECT 'subscriptions', CAST(count(*) AS VARCHAR), CAST(-sum(annual_cost_cents) AS BIGINT) FROM every WHERE found AND active AND kind='subscription' HAVING count(*)>0
UNION ALL SELECT * FROM (SELECT 'cut_by_a_fifth', category, a//5 FROM b WHERE NOT essential AND category<>'Uncategorized' ORDER BY a DESC, category LIMIT 2)
UNION ALL SELECT 'over_budget', id, CAST(sp-lim AS BIGINT) FROM m WHERE sp>lim""")
def spend_recommendations(spark, sf):
    from opsloom.checks.insights import budgets
    from opsloom.operators.planning import budget_status
    from opsloom.operators.recurring import recurring
    rows, cats = T.ledger(spark, sf), T.categories(spark, sf)
    start, end = dt.date(1998, 1, 1), dt.date(1998, 12, 31)
    subs = recurring(T.subscriptions(spark, sf), T.plan_categories(spark))
    return N.recommendations(Q.summary(rows, start, end), Q.category_breakdown(rows, cats, start, end), subs,
                             budget_status(rows, budgets(spark, sf), "1998-08"))
