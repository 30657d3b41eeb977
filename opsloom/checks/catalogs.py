"""Registered catalogue and library queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from opsloom.checks.registry import Registry, sql_pick, sql_text
from opsloom.functions import titles as X
from opsloom.operators import catalog as B
from opsloom.operators import library as G
from opsloom.sources import tables as T

REG = Registry()


def t(p: str) -> str:
    return sql_text(p)


def norm_key_sql(x: str) -> str:
    s = f"lower(strip_accents(coalesce({x},'')))"
    s = f"trim(regexp_replace(regexp_replace({s},{t(X.BRACKETED)},' ','g'),{t(X.NOISE)},' ','g'))"
    s = f"regexp_replace(trim(regexp_replace({s},{t(X.LAST_ARTICLE)},'')),{t(X.ARTICLE)},'')"
    return f"trim(regexp_replace(regexp_replace({s},'[^a-z0-9 ]+',' ','g'),'\\s+',' ','g'))"


def seq_sql(a: str, b: str) -> str:
    return f"CASE WHEN {a}='' OR {b}='' THEN 0.0::DOUBLE WHEN {a}={b} THEN 100.0::DOUBLE ELSE (length({a})+length({b})-levenshtein({a},{b}))*100.0::DOUBLE/(length({a})+length({b})) END"


def token_ctes(source: str, a: str, b: str, out: str) -> str:
    """CTEs adding tok (token-set ratio) and sq (sequence ratio) of columns a and b."""
    w = lambda c: f"list_distinct(list_filter(string_split({c},' '), lambda x: x<>''))"
    j = lambda x: f"array_to_string({x},' ')"
    return f"""{out}_1 AS (SELECT *, {w(a)} AS wa, {w(b)} AS wb FROM {source}),
{out}_2 AS (SELECT *, list_sort(list_filter(wa, lambda x: list_contains(wb,x))) AS c, list_sort(list_filter(wa, lambda x: NOT list_contains(wb,x))) AS oa, list_sort(list_filter(wb, lambda x: NOT list_contains(wa,x))) AS ob FROM {out}_1),
{out}_3 AS (SELECT *, {j('c')} AS cs, {j('list_concat(c,oa)')} AS sa, {j('list_concat(c,ob)')} AS sb FROM {out}_2),
{out} AS (SELECT *, CASE WHEN {a}='' OR {b}='' THEN 0.0::DOUBLE WHEN {a}={b} THEN 100.0::DOUBLE WHEN len(c)>0 AND (len(oa)=0 OR len(ob)=0) THEN 100.0::DOUBLE
 ELSE greatest({seq_sql('sa', 'sb')},{seq_sql('cs', 'sa')},{seq_sql('cs', 'sb')}) END AS tok, {seq_sql(a, b)} AS sq FROM {out}_3)"""


def initcap(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x},' '), lambda w: upper(left(w,1))||lower(substr(w,2))),' ')"


TITLES = f"""ti AS (SELECT p_partkey AS k, replace(replace(replace(replace({sql_pick(f'p_partkey%{len(T.TITLE_FORMS)}', T.TITLE_FORMS)},'{{t}}',{initcap('p_name')}),'{{s}}',{initcap('p_type')}),'{{n}}',CAST(p_partkey%20 AS VARCHAR)),'{{i}}',lpad(CAST(p_partkey AS VARCHAR),8,'0')) AS raw,
 {initcap('p_type')} AS series, CAST(p_partkey%20 AS INTEGER) AS n, p_brand AS author, {sql_pick('p_partkey%5', ['English', ' german', 'de', 'x', 'Klingon'])} AS language FROM part)"""


def title_rows(spark, sf):
    return T.titles(spark, sf)


@REG.query("title_norm_key", f"WITH {TITLES} SELECT k, {norm_key_sql('raw')} AS key FROM ti")
def title_norm_key(spark, sf):
    return title_rows(spark, sf).select("k", X.norm_key(F.col("raw")).alias("key"))


@REG.query("title_clean", f"""WITH {TITLES}, a AS (SELECT k, regexp_extract(raw,{t(X.NUMBER_FIRST)},1) AS num, regexp_replace(regexp_replace(raw,{t(X.NUMBER_FIRST)},''),{t(X.NOISE)},' ','g') AS x FROM ti),
b AS (SELECT k, num, trim(regexp_replace(replace(regexp_replace(x,'[\\(\\[]\\s*[\\)\\]]',' ','g'),'_',' '),'\\s+',' ','g'),' -–—._') AS x FROM a)
SELECT k, trim(regexp_replace(x,{t(X.LAST_ARTICLE)},'')) AS title, CAST(NULLIF(num,'') AS INTEGER) AS number FROM b""")
def title_clean(spark, sf):
    return title_rows(spark, sf).select("k", X.clean_title(F.col("raw")).alias("c")).select("k", "c.*")


@REG.query("title_split_series", f"""WITH {TITLES}, a AS (SELECT k, raw, trim(regexp_replace(raw,{t(X.SERIES_LAST)},''),' -–—,') AS base, trim(regexp_extract(raw,{t(X.SERIES_LAST)},1),' -–—,') AS s, regexp_extract(raw,{t(X.SERIES_LAST)},2) AS num FROM ti),
b AS (SELECT *, regexp_matches(raw,{t(X.SERIES_LAST)}) AND base<>'' AND s<>'' AND length(s)<80 AS hit FROM a)
SELECT k, CASE WHEN hit THEN base ELSE raw END AS title, CASE WHEN hit THEN s END AS series, CASE WHEN hit THEN CAST(num AS INTEGER) END AS number FROM b""")
def title_split_series(spark, sf):
    return title_rows(spark, sf).select("k", X.split_series(F.col("raw")).alias("s")).select("k", "s.*")


def suffix_sql(x: str) -> str:
    head = X.HEAD_TAIL.replace("\\x{2013}", "–").replace("\\x{2014}", "—")
    cut = f"CASE WHEN regexp_extract({x},{t(head)},1)<>'' AND regexp_matches(regexp_extract({x},{t(head)},2),{t(X.SERIES_WORD)}) THEN regexp_extract({x},{t(head)},1) ELSE {x} END"
    done = f"trim(regexp_replace(trim(regexp_replace({cut},{t(X.LAST_NUMBERS)},''),' -–—,;:'),{t(X.LAST_EDITION)},''))"
    return f"CASE WHEN trim({done})<>'' THEN {done} ELSE {x} END"


@REG.query("title_strip_suffix", f"WITH {TITLES}, a AS (SELECT k, trim(raw) AS raw FROM ti) SELECT k, {suffix_sql('raw')} AS title FROM a")
def title_strip_suffix(spark, sf):
    return title_rows(spark, sf).select("k", X.strip_title_suffix(F.trim("raw")).alias("title"))


PREFIX = f"""a AS (SELECT *, ltrim(raw) AS st FROM ti), b AS (SELECT *, CASE WHEN starts_with(lower(st),lower(series)) THEN substr(st,length(series)+1) END AS rest FROM a),
c AS (SELECT *, CASE WHEN rest IS NOT NULL AND regexp_matches(rest,{t(X.AFTER_SERIES)}) AND regexp_replace(rest,{t(X.AFTER_SERIES)},'')<>'' THEN trim(regexp_replace(rest,{t(X.AFTER_SERIES)},'')) ELSE raw END AS y FROM b),
d AS (SELECT *, CASE WHEN regexp_matches(y,{t(X.NUMBER_FIRST)}) AND regexp_replace(y,{t(X.NUMBER_FIRST)},'')<>'' THEN trim(regexp_replace(y,{t(X.NUMBER_FIRST)},'')) ELSE y END AS z FROM c)"""


@REG.query("title_strip_series", f"WITH {TITLES}, {PREFIX} SELECT k, z AS title FROM d")
def title_strip_series(spark, sf):
    return title_rows(spark, sf).select("k", X.strip_series_prefix(F.col("raw"), F.col("series")).alias("title"))


@REG.query("title_clean_book", f"""WITH {TITLES.replace('ti AS (', 'ti0 AS (')}, ti AS (SELECT * REPLACE (trim(raw) AS raw) FROM ti0), {PREFIX},
e AS (SELECT *, trim(regexp_extract(raw,'#\\s*\\d+\\s*[:\\-–—]\\s*(.+)$',1)) AS af, trim(z) AS s FROM d),
g AS (SELECT *, trim(s,' :-–—') AS bare, regexp_extract(s,'^(\\d{{1,3}})\\s*[:\\-–—]\\s+(.+)$',1) AS ln, trim(regexp_extract(s,'^(\\d{{1,3}})\\s*[:\\-–—]\\s+(.+)$',2)) AS ls FROM e)
SELECT k, CASE WHEN length(af)>=3 THEN af WHEN s=raw THEN raw WHEN regexp_matches(s,{t(X.GENERIC_SUBTITLE)}) THEN series||' '||CAST(n AS VARCHAR) WHEN ln<>'' AND CAST(NULLIF(ln,'') AS INTEGER)=n AND length(ls)>=3 THEN ls
 WHEN regexp_matches(s,'^\\d{{1,3}}\\b') THEN raw WHEN length(bare)>=3 THEN bare ELSE raw END AS title FROM g""")
def title_clean_book(spark, sf):
    return title_rows(spark, sf).select("k", X.clean_book_title(F.col("raw"), F.col("series"), F.col("n")).alias("title"))


@REG.query("title_junk", f"WITH {TITLES} SELECT k, CASE WHEN NOT (regexp_matches(raw,{t(X.JUNK)}) OR raw='') THEN raw END AS title FROM ti")
def title_junk(spark, sf):
    return B.drop_junk(title_rows(spark, sf).select("k", F.col("raw").alias("title")), ["title"])


@REG.query("find_product_id", f"""WITH {TITLES}, x AS (SELECT k, raw, 'audible.com/pd/The-Lives/'||lpad(CAST(k AS VARCHAR),10,'1') AS u FROM ti)
SELECT k, coalesce(NULLIF(regexp_extract(upper(raw),{t(X.PRODUCT_ID)},1),''), NULLIF(regexp_extract(upper(u),{t(X.PRODUCT_ID)},1),''), NULLIF(upper(regexp_extract(raw,{t(X.NUMERIC_ID)},1)),''), NULLIF(upper(regexp_extract(u,{t(X.NUMERIC_ID)},1)),'')) AS product_id FROM x""")
def find_product_id(spark, sf):
    url = F.concat(F.lit("audible.com/pd/The-Lives/"), F.lpad(F.col("k").cast("string"), 10, "1"))
    return title_rows(spark, sf).select("k", X.find_product_id(F.col("raw"), url).alias("product_id"))


@REG.query("title_scalars", f"""WITH {TITLES}, v AS (SELECT *, lower(trim(language)) AS l FROM ti)
SELECT k, CASE l WHEN 'english' THEN 'eng' WHEN 'german' THEN 'ger' ELSE CASE WHEN length(l)>=3 THEN left(l,3) END END AS language, CAST(NULLIF(regexp_extract(raw,'\\d{{1,4}}'),'') AS INTEGER) AS first_int,
 CAST(NULLIF(regexp_extract(raw,'(1[5-9]\\d{{2}}|20\\d{{2}})',1),'') AS INTEGER) AS first_year FROM v""")
def title_scalars(spark, sf):
    return title_rows(spark, sf).select("k", X.norm_language(F.col("language")).alias("language"), X.first_int(F.col("raw")).alias("first_int"), X.first_year(F.col("raw")).alias("first_year"))


def variants_sql(x: str) -> str:
    num = f"trim(regexp_extract({x},'#\\s*\\d+\\s*[:\\-–—]\\s*(.+)$',1))"
    tail, head = f"trim(string_split({x},':')[-1])", f"trim(string_split({x},':')[1])"
    raw = f"[{x}, CASE WHEN length({num})>=4 THEN {num} END, CASE WHEN contains({x},':') AND length({tail})>=4 THEN {tail} END, CASE WHEN contains({x},':') AND length({head})>=4 THEN {head} END]"
    return f"list_distinct(list_filter({raw}, lambda v: v IS NOT NULL))"


@REG.query("title_variants", f"WITH {TITLES} SELECT k, array_to_string(list_sort({variants_sql('raw')}),'|') AS variants FROM ti")
def title_variants(spark, sf):
    return title_rows(spark, sf).select("k", F.array_join(F.array_sort(X.title_variants(F.col("raw"))), "|").alias("variants"))


CAT = """ca0 AS (SELECT p_partkey AS k, p_brand, p_name||' of '||lower(p_type)||' '||substr(md5(CAST(p_partkey%400 AS VARCHAR)),1,9)||' '||substr(md5(CAST(p_partkey%400 AS VARCHAR)),10,8)||CASE WHEN p_partkey%7=0 THEN ': '||p_name||' again' ELSE '' END AS title FROM part),
ca AS (SELECT k AS cat_id, 'Lib/'||p_brand||'/'||title||' vol '||CAST(k AS VARCHAR) AS path, title, 'Writer '||CAST(k%40 AS VARCHAR)||' '||p_brand AS author,
 CASE WHEN k%4=0 THEN 'B0'||lpad(CAST(k AS VARCHAR),8,'0') ELSE '' END AS product_id, 'Reader '||CAST(k%3 AS VARCHAR) AS narrator FROM ca0),
it AS (SELECT 'i'||CAST(cat_id AS VARCHAR) AS id, cat_id AS k, CASE cat_id%5 WHEN 1 THEN upper(path) WHEN 2 THEN path||'x' WHEN 3 THEN 'inbox/'||CAST(cat_id AS VARCHAR) ELSE '' END AS path,
 CASE cat_id%3 WHEN 0 THEN """ + initcap("title") + """ WHEN 1 THEN title||' (Unabridged)' ELSE replace(title,' of ',' off ') END AS title,
 CASE WHEN cat_id%6<>0 THEN author ELSE '' END AS author, product_id, CASE WHEN cat_id%2=0 THEN narrator END AS narrator FROM ca)"""

SCORED = f"""hk AS (SELECT id, author, narrator, {norm_key_sql('ts')} AS hkey FROM (SELECT *, {suffix_sql('tt')} AS ts FROM (SELECT *, trim(title) AS tt FROM {{items}}))),
ck AS (SELECT cat_id, author AS ca_author, narrator AS ca_narrator, {norm_key_sql('v')} AS ckey FROM (SELECT *, unnest({variants_sql('title')}) AS v FROM ca)),
pr0 AS (SELECT h.hkey, c.ckey FROM (SELECT DISTINCT hkey FROM hk WHERE hkey<>'') h, (SELECT DISTINCT ckey FROM ck WHERE ckey<>'') c),
{token_ctes('pr0', 'hkey', 'ckey', 'pr1')},
pr AS (SELECT hkey, ckey, tok*0.35::DOUBLE+sq*0.65::DOUBLE AS s FROM pr1 WHERE tok*0.35::DOUBLE+sq*0.65::DOUBLE>=({{floor}}-30)/0.75::DOUBLE),
au0 AS (SELECT a, b, {norm_key_sql('a')} AS ka, {norm_key_sql('b')} AS kb FROM (SELECT DISTINCT hk.author AS a, ck.ca_author AS b FROM hk JOIN pr USING (hkey) JOIN ck USING (ckey))),
{token_ctes('au0', 'ka', 'kb', 'au1')},
na0 AS (SELECT a, b, {norm_key_sql('a')} AS ka, {norm_key_sql('b')} AS kb FROM (SELECT * FROM (SELECT DISTINCT narrator AS a FROM hk WHERE narrator IS NOT NULL), (SELECT DISTINCT ca_narrator AS b FROM ck))),
{token_ctes('na0', 'ka', 'kb', 'na1')},
j0 AS (SELECT hk.id, ck.cat_id, pr.s, au1.tok AS atok, coalesce(ka,'')<>'' AND coalesce(kb,'')<>'' AS both_a, hk.narrator, ck.ca_narrator FROM hk JOIN pr USING (hkey) JOIN ck USING (ckey) JOIN au1 ON au1.a=hk.author AND au1.b=ck.ca_author),
j1 AS (SELECT id, cat_id, narrator, ca_narrator, CASE WHEN NOT both_a THEN s WHEN atok>=60 THEN s*0.75::DOUBLE+atok*0.25::DOUBLE ELSE greatest(0.0::DOUBLE, s-8.0::DOUBLE) END AS a FROM j0),
sc AS (SELECT id, cat_id, max(CASE WHEN narrator IS NOT NULL AND na1.tok>85 THEN least(100.0::DOUBLE, j1.a+5.0::DOUBLE) ELSE j1.a END) AS score FROM j1 LEFT JOIN na1 ON na1.a=j1.narrator AND na1.b=j1.ca_narrator GROUP BY 1,2 HAVING max(CASE WHEN narrator IS NOT NULL AND na1.tok>85 THEN least(100.0::DOUBLE, j1.a+5.0::DOUBLE) ELSE j1.a END)>={{floor}})"""


@REG.query("match_score", f"""WITH {CAT}, p AS (SELECT it.id, ca.cat_id, {norm_key_sql('ts')} AS hkey, it.author AS a, ca.author AS b, unnest({variants_sql('ct')}) AS v
 FROM (SELECT *, {suffix_sql('tt')} AS ts FROM (SELECT *, trim(title) AS tt FROM it)) it JOIN (SELECT *, title AS ct FROM ca) ca ON ca.cat_id=it.k+1),
q AS (SELECT id, cat_id, hkey, a, b, {norm_key_sql('v')} AS ckey FROM p), {token_ctes('q', 'hkey', 'ckey', 'r')},
m AS (SELECT id, any_value({norm_key_sql('a')}) AS ka, any_value({norm_key_sql('b')}) AS kb, max(tok*0.35::DOUBLE+sq*0.65::DOUBLE) AS s FROM r GROUP BY id), {token_ctes('m', 'ka', 'kb', 'z')}
SELECT id, round(CASE WHEN ka='' OR kb='' THEN s WHEN tok>=60 THEN s*0.75::DOUBLE+tok*0.25::DOUBLE ELSE greatest(0.0::DOUBLE,s-8.0::DOUBLE) END*1000000) AS score_ppm FROM z""")
def match_score(spark, sf):
    """Every item against the entry after its own."""
    i = T.items(spark, sf).select("id", "title", "author", (F.substring("id", 2, 20).cast("long") + 1).alias("cat_id"))
    c = T.catalog(spark, sf).select("cat_id", F.col("title").alias("c_title"), F.col("author").alias("c_author"))
    return i.join(c, "cat_id").select("id", F.round(X.match_score(F.col("title"), F.col("author"), F.col("c_title"), F.col("c_author")) * 1000000).alias("score_ppm"))


@REG.query("catalog_candidates", f"""WITH {CAT}, {SCORED.format(items='it', floor=82)}
SELECT id, cat_id, rank, round(score*1000000) AS score_ppm FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cat_id) AS rank FROM sc) WHERE rank<=8""")
def catalog_candidates(spark, sf):
    return B.top_candidates(T.items(spark, sf), T.catalog(spark, sf)).select("id", "cat_id", "rank", F.round(F.col("score") * 1000000).alias("score_ppm"))


@REG.query("catalog_ambiguous", f"""WITH {CAT}, {SCORED.format(items='it', floor=82)}, mx AS (SELECT id, max(score) AS top FROM sc GROUP BY 1),
b AS (SELECT id, cat_id FROM sc QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cat_id)=1)
SELECT b.id, b.cat_id, count(*) FILTER (sc.score>=mx.top-0.5::DOUBLE)>=2 AS ambiguous FROM b JOIN mx USING (id) JOIN sc ON sc.id=b.id GROUP BY 1,2""")
def catalog_ambiguous(spark, sf):
    return B.ambiguous_match(T.items(spark, sf), T.catalog(spark, sf)).select("id", "cat_id", "ambiguous")


def path_key_sql(x: str) -> str:
    return norm_key_sql(f"replace(regexp_replace(replace({x},'\\','/'),'^[/ ]+|[/ ]+$','','g'),'/',' ')")


@REG.query("link_catalog", f"""WITH {CAT}, s1 AS (SELECT id, max(ca.cat_id) AS cat_id, 100.0::DOUBLE AS score, 'product_id' AS how FROM it JOIN ca USING (product_id) WHERE product_id<>'' GROUP BY 1),
l1 AS (SELECT *, {path_key_sql('path')} AS key FROM it WHERE id NOT IN (SELECT id FROM s1)), pk AS (SELECT key, max(cat_id) AS cat_id FROM (SELECT cat_id, {path_key_sql('path')} AS key FROM ca) WHERE key<>'' GROUP BY 1),
s2 AS (SELECT id, pk.cat_id, 100.0::DOUBLE AS score, 'path' AS how FROM l1 JOIN pk USING (key)),
l2 AS (SELECT * FROM l1 WHERE id NOT IN (SELECT id FROM s2)),
nr AS (SELECT l2.id, pk.cat_id, pk.key AS pkey, {seq_sql('l2.key', 'pk.key')} AS r FROM l2, pk WHERE l2.key<>'' AND abs(length(l2.key)-length(pk.key))<=6),
s3 AS (SELECT id, cat_id, r AS score, 'path~' AS how FROM nr WHERE r>=97 QUALIFY row_number() OVER (PARTITION BY id ORDER BY r DESC, pkey DESC)=1),
l3 AS (SELECT * FROM l2 WHERE id NOT IN (SELECT id FROM s3)), {SCORED.format(items='l3', floor=90)},
s4 AS (SELECT id, cat_id, score, 'title' AS how FROM sc WHERE score>=90 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, cat_id)=1)
SELECT id, cat_id, round(score*1000000) AS score_ppm, how FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4)""")
def link_catalog(spark, sf):
    return B.link_catalog(T.items(spark, sf), T.catalog(spark, sf)).select("id", "cat_id", F.round(F.col("score") * 1000000).alias("score_ppm"), "how")


def two_catalogs(spark, sf):
    c = T.catalog(spark, sf).withColumnRenamed("cat_id", "row_ord")
    k = F.col("row_ord")
    first = c.filter(k % 3 != 0).withColumn("narrator", F.lit("")).withColumn("author", F.when(k % 5 == 0, " ").otherwise(F.col("author")))
    second = c.withColumn("path", F.when(k % 8 == 4, "").otherwise(F.upper("path"))).withColumn("title", F.upper("title"))
    return [first, second]


MERGE_FIELDS = ["path", "title", "author", "product_id", "narrator"]


@REG.query("merge_catalogs", f"""WITH {CAT}, r AS (SELECT 0 AS so, cat_id AS ro, path, title, CASE WHEN cat_id%5=0 THEN ' ' ELSE author END AS author, product_id, '' AS narrator FROM ca WHERE cat_id%3<>0
 UNION ALL SELECT 1, cat_id, CASE WHEN cat_id%8=4 THEN '' ELSE upper(path) END, upper(title), author, product_id, narrator FROM ca),
i AS (SELECT *, coalesce(NULLIF({path_key_sql('path')},''), NULLIF(trim(product_id),'')) AS ident FROM r)
SELECT ident, first(title ORDER BY so, ro) FILTER (trim(title)<>'') AS title, first(author ORDER BY so, ro) FILTER (trim(author)<>'') AS author, first(narrator ORDER BY so, ro) FILTER (trim(narrator)<>'') AS narrator FROM i WHERE ident IS NOT NULL GROUP BY 1""")
def merge_catalogs(spark, sf):
    return B.merge_catalogs(two_catalogs(spark, sf), MERGE_FIELDS).select("ident", "title", "author", "narrator")


def three_sources(spark, sf):
    c = T.catalog(spark, sf).withColumnRenamed("cat_id", "id")
    k = F.col("id")
    return {"folder": c.select("id", F.lit("f").alias("title"), F.lit("f").alias("author"), F.lit("f").alias("narrator")),
            "existing": c.filter(k % 2 == 0).select("id", F.lit("").alias("title"), "author", F.lit(None).cast("string").alias("narrator")),
            "audible": c.filter(k % 3 == 0).select("id", "title", F.lit(" ").alias("author"), F.when(k % 9 == 0, F.col("narrator")).alias("narrator"))}


@REG.query("coalesce_sources", f"""WITH {CAT} SELECT cat_id AS id, CASE WHEN cat_id%3=0 THEN title ELSE 'f' END AS title, CASE WHEN cat_id%2=0 THEN author ELSE 'f' END AS author, CASE WHEN cat_id%9=0 THEN narrator ELSE 'f' END AS narrator,
 array_to_string(list_filter([CASE WHEN cat_id%3=0 THEN 'audible' END, CASE WHEN cat_id%2=0 THEN 'existing' END, CASE WHEN NOT (cat_id%18=0) THEN 'folder' END], lambda x: x IS NOT NULL),',') AS contributors FROM ca""")
def coalesce_sources(spark, sf):
    return B.coalesce_sources(three_sources(spark, sf), ["title", "author", "narrator"]).withColumn("contributors", F.array_join("contributors", ","))


@REG.query("coalesce_sources_overwrite", f"""WITH {CAT} SELECT cat_id AS id, 'f' AS title, 'f' AS author, 'f' AS narrator FROM ca""")
def coalesce_sources_overwrite(spark, sf):
    return B.coalesce_sources(three_sources(spark, sf), ["title", "author", "narrator"], overwrite=True).drop("contributors")


@REG.query("field_coverage", f"""WITH {CAT}, s AS (SELECT 'folder' AS source, 'f' AS title, 'f' AS author FROM ca UNION ALL SELECT 'existing','',author FROM ca WHERE cat_id%2=0 UNION ALL SELECT 'audible', title, ' ' FROM ca WHERE cat_id%3=0)
SELECT source, 'title' AS field, count(*) FILTER (trim(title)<>'') AS filled FROM s GROUP BY 1 UNION ALL SELECT source, 'author', count(*) FILTER (trim(author)<>'') FROM s GROUP BY 1""")
def field_coverage(spark, sf):
    rows = [df.select(F.lit(s).alias("source"), "title", "author") for s, df in three_sources(spark, sf).items()]
    return B.coverage(rows[0].unionByName(rows[1]).unionByName(rows[2]), ["title", "author"], ["source"])


@REG.query("source_ranking", f"""WITH {CAT} SELECT * FROM (SELECT 'folder' AS source, 2*count(*) AS filled FROM ca UNION ALL SELECT 'existing', count(*) FROM ca WHERE cat_id%2=0 UNION ALL SELECT 'audible', count(*) FROM ca WHERE cat_id%3=0)""")
def source_ranking(spark, sf):
    return B.rank_sources(field_coverage(spark, sf))


@REG.query("infer_from_path", f"""WITH {TITLES}, p AS (SELECT k, author, CASE k%3 WHEN 0 THEN '02 - Foo (Dark Tower, Book 4)' WHEN 1 THEN '03 - Bar' ELSE 'Baz mp3' END AS leaf, k%4 AS d FROM ti)
SELECT k, CASE WHEN d>=1 THEN author END AS author, CASE WHEN k%3=0 THEN 'Dark Tower' WHEN d>=2 THEN 'Saga' END AS series, CASE k%3 WHEN 0 THEN 'Foo' WHEN 1 THEN 'Bar' ELSE 'Baz' END AS title,
 CASE WHEN k%3=0 THEN '4' WHEN k%3=1 AND d>=2 THEN '3' END AS series_index FROM p""")
def infer_from_path(spark, sf):
    k = F.col("k")
    leaf = T.pick(k % 3, ["02 - Foo (Dark Tower, Book 4)", "03 - Bar", "Baz mp3"])
    path = F.when(k % 4 == 0, leaf).when(k % 4 == 1, F.concat_ws("/", "author", leaf)).otherwise(F.concat_ws("/", "author", F.lit("Saga"), leaf))
    return title_rows(spark, sf).select("k", B.infer_from_path(path).alias("m")).select("k", "m.*")


@REG.query("group_files")
def group_files(spark, sf):
    return B.group_files(T.audio_files(spark, sf).select("path", "album"))


def plain_books(spark, sf):
    k = F.col("l_orderkey")
    name = F.when(k % 6 == 0, "/m4b").when(k % 6 == 1, "/MP3").otherwise("")
    return T.table(spark, sf, "lineitem").select(F.concat(F.lit("lib/o"), (k - k % 6).cast("string"), name).alias("folder"))


@REG.query("format_variants", """WITH b AS (SELECT DISTINCT 'lib/o'||CAST(l_orderkey-l_orderkey%6 AS VARCHAR) AS p, CASE l_orderkey%6 WHEN 0 THEN '/m4b' WHEN 1 THEN '/MP3' ELSE '' END AS s FROM lineitem)
SELECT p||s AS folder, p AS parent FROM b WHERE s<>'' AND p IN (SELECT p FROM b WHERE s='')""")
def format_variants(spark, sf):
    return B.format_variants(plain_books(spark, sf))


@REG.query("book_duplicates", f"""WITH {CAT}, u AS (SELECT 'c'||CAST(cat_id AS VARCHAR) AS id, title, author FROM ca UNION ALL SELECT id, title, author FROM it),
k AS (SELECT id, {norm_key_sql('author')}||'|'||{norm_key_sql('title')} AS dup_key FROM u) SELECT id, dup_key, copies FROM (SELECT *, count(*) OVER (PARTITION BY dup_key) AS copies FROM k) WHERE copies>1""")
def book_duplicates(spark, sf):
    entries = T.catalog(spark, sf).select(F.concat(F.lit("c"), F.col("cat_id").cast("string")).alias("id"), "title", "author")
    return B.find_duplicates(entries.unionByName(T.items(spark, sf).select("id", "title", "author"))).select("id", "dup_key", "copies")


MARKS = " [0-9a-f]{9} [0-9a-f]{8}"


def books(spark, sf):
    k = F.col("cat_id")
    blank = lambda m, c: F.when(k % m != 0, c).otherwise("")
    return T.catalog(spark, sf).select(
        k.alias("id"), F.col("path"), blank(9, F.regexp_replace("title", MARKS, "")).alias("title"), blank(7, F.col("author")).alias("author"), blank(5, F.col("narrator")).alias("narrator"),
        F.lit("Audio").alias("genre"), blank(3, F.lit("Pub")).alias("publisher"), F.lit("2001").alias("year"), blank(11, F.lit("d")).alias("description"),
        (k % 4 != 1).alias("has_cover"), "product_id", F.when(k % 2 == 0, "Saga: 1/2").otherwise("").alias("series"), (k % 30).cast("string").alias("series_index"),
        F.when(k % 10 < 7, F.lit(100.0) - (k % 10) * 0.2).alias("match_score"), (k % 4).alias("files"))


ISSUES = f"""{CAT}, bk AS (SELECT *, list_filter([CASE WHEN cat_id%9=0 THEN 'Missing Album/Title' END, CASE WHEN cat_id%7=0 THEN 'Missing Author' END, CASE WHEN cat_id%5=0 THEN 'Missing Narrator' END,
 CASE WHEN cat_id%3=0 THEN 'Missing Publisher' END, CASE WHEN cat_id%11=0 THEN 'Missing Description' END, CASE WHEN cat_id%4=1 THEN 'Missing Cover' END], lambda x: x IS NOT NULL) AS issues FROM ca),
bs AS (SELECT *, CASE WHEN len(issues)=0 THEN 'ok' WHEN (cat_id%9<>0 AND cat_id%7<>0) OR product_id<>'' THEN 'issues' ELSE 'unknown' END AS status FROM bk)"""


@REG.query("book_completeness", f"WITH {ISSUES} SELECT cat_id AS id, array_to_string(issues,'|') AS issues, status FROM bs")
def book_completeness(spark, sf):
    return B.completeness(books(spark, sf)).select("id", F.array_join("issues", "|").alias("issues"), "status")


@REG.query("book_run_summary", f"""WITH {ISSUES} SELECT count(*) AS books, count(*) FILTER (status='ok') AS ok, count(*) FILTER (status='issues') AS issues, count(*) FILTER (status='unknown') AS unknown, count(*) FILTER (len(issues)>0) AS with_issues,
 count(*) FILTER (cat_id%10 BETWEEN 1 AND 6) AS below_100_match, CAST(sum(cat_id%4) AS BIGINT) AS files FROM (SELECT * FROM bs)""")
def book_run_summary(spark, sf):
    return B.run_summary(B.completeness(books(spark, sf)))


@REG.query("track_gaps", """WITH f AS (SELECT 'o'||CAST(l_orderkey AS VARCHAR) AS book, CASE WHEN l_orderkey%8=0 THEN l_linenumber%2+1 ELSE 1 END AS disc, CASE WHEN l_partkey%9<>0 THEN l_linenumber END AS tr FROM lineitem),
g AS (SELECT book, disc, count(*) AS n, count(tr) AS c, count(DISTINCT tr) AS d, min(tr) AS lo, max(tr) AS hi FROM f GROUP BY 1,2), h AS (SELECT *, count(*) OVER (PARTITION BY book) AS discs FROM g)
SELECT book, disc, CASE WHEN discs>1 THEN 'disc '||CAST(disc AS VARCHAR)||': ' ELSE '' END||CASE WHEN c<n THEN 'some files have no track number' ELSE 'track numbers are not 1..'||CAST(n AS VARCHAR) END AS note FROM h WHERE n>=2 AND (c<n OR d<>n OR lo<>1 OR hi<>n)""")
def track_gaps(spark, sf):
    return B.track_gaps(T.audio_files(spark, sf))


DEST = f"""ds AS (SELECT *, CASE WHEN cat_id%9<>0 AND cat_id%7<>0 THEN CASE WHEN cat_id%2=0 THEN author||'/Saga 1, 2/Book '||lpad(CAST(cat_id%30 AS VARCHAR),2,'0')||' - '||replace(title,':','') ELSE author||'/'||replace(title,':','') END END AS destination FROM (SELECT * REPLACE (regexp_replace(title,{t(MARKS)},'') AS title) FROM ca))"""


@REG.query("plan_layout", f"WITH {CAT}, {DEST} SELECT cat_id AS id, destination FROM ds")
def plan_layout(spark, sf):
    return B.plan_layout(books(spark, sf)).select("id", "destination")


PLAN = f"""{DEST}, p0 AS (SELECT *, CASE WHEN cat_id%10 BETWEEN 3 AND 6 AND product_id='' THEN 'held' WHEN destination IS NULL THEN 'undetermined' WHEN cat_id%13=0 THEN 'in_place' END AS b0 FROM ds),
p1 AS (SELECT lower(destination) AS low, count(*) AS n FROM p0 WHERE b0 IS NULL GROUP BY 1), p2 AS (SELECT cat_id AS id, coalesce(b0, CASE WHEN n>1 THEN 'conflict' ELSE 'move' END) AS bucket FROM p0 LEFT JOIN p1 ON low=lower(destination))"""


def planned(spark, sf):
    laid = B.plan_layout(books(spark, sf))
    return B.plan(laid.withColumn("path", F.when(F.col("id") % 13 == 0, F.col("destination")).otherwise(F.col("path"))))


@REG.query("plan_conflicts", f"WITH {CAT}, {PLAN} SELECT id, bucket FROM p2")
def plan_conflicts(spark, sf):
    return planned(spark, sf).select("id", "bucket")


@REG.query("plan_accounting", f"WITH {CAT}, {PLAN} SELECT bucket, count(*) AS books FROM p2 GROUP BY 1")
def plan_accounting(spark, sf):
    return B.plan_accounting(planned(spark, sf))


@REG.query("natural_sort", f"""WITH {TITLES} SELECT k, array_to_string(list_transform(regexp_extract_all(lower(raw),'(\\d+|\\D+)'), lambda r: CASE WHEN regexp_matches(r,'^\\d') THEN lpad(CAST(length(CASE WHEN ltrim(r,'0')='' THEN '0' ELSE ltrim(r,'0') END) AS VARCHAR),6,'0')||CASE WHEN ltrim(r,'0')='' THEN '0' ELSE ltrim(r,'0') END ELSE r END),'') AS key FROM ti""")
def natural_sort(spark, sf):
    return title_rows(spark, sf).select("k", X.natural_key(F.col("raw")).alias("key"))


@REG.query("title_from_file", f"""WITH {TITLES}, s AS (SELECT k, author||' - '||series||' - '||CAST(n AS VARCHAR)||' Collapse' AS stem FROM ti) SELECT k, 'Collapse' AS title FROM s""")
def title_from_file(spark, sf):
    stem = F.concat("author", F.lit(" - "), "series", F.lit(" - "), F.col("n").cast("string"), F.lit(" Collapse"))
    return title_rows(spark, sf).select("k", X.title_from_file(stem, F.col("author"), F.col("series")).alias("title"))


@REG.query("restore_snapshot", f"""WITH {CAT} SELECT cat_id, CASE WHEN cat_id%6=0 THEN 'new' ELSE title END AS title FROM ca""")
def restore_snapshot(spark, sf):
    now = T.catalog(spark, sf).withColumn("id", F.col("cat_id").cast("string"))
    took = lambda at, title: now.filter(F.col("cat_id") % 6 == 0).select("id", F.lit(at).alias("taken_at"), title.alias("title"))
    snaps = took("2026-01-02", F.lit("new")).unionByName(took("2026-01-01", F.lit("old")))
    return B.restore(now, snaps, ["title"]).select("cat_id", "title")


# --- library -------------------------------------------------------------------------------------------------------------

P = "p_partkey"
GAMES = f"""gm AS (SELECT {P} AS id, p_name AS name, p_type, p_brand, {sql_pick(P + '%4', ['Steam', 'GOG', '', 'Epic'])} AS store, CASE WHEN {P}%5<>0 THEN {P}*977%100000 END AS sec,
 CASE WHEN {P}%3<>0 THEN DATE '2020-01-01'+CAST({P}%2000 AS INTEGER) END AS lp, CASE WHEN {P}%7<>0 THEN DATE '1999-01-01'+CAST({P}%9000 AS INTEGER) END AS rel,
 coalesce(CASE WHEN {P}%6=0 THEN {P}%101 END, CASE WHEN {P}%4=0 THEN {P}*3%101 END, CASE WHEN {P}%9=0 THEN {P}*7%101 END) AS rating,
 CASE WHEN {P}%8<>0 THEN {sql_pick(P + '%5', ['Single Player', 'Multi-player', 'Online Co-Op', 'PvP', 'Versus'])} END AS feat FROM part),
gs AS (SELECT *, CASE WHEN store='' THEN 'None' ELSE store END AS st, CASE WHEN rating IS NULL THEN -1 ELSE greatest(0,least(5,CAST(floor(rating/20+0.5) AS INTEGER))) END AS stars FROM gm)"""


@REG.query("library_inventory", f"""WITH {GAMES} SELECT id, name, st AS store, round_even(sec/36,0)/100 AS hours, coalesce(strftime(lp,'%Y-%m-%d'),'') AS last_played, '2019-05-05' AS added, coalesce(strftime(rel,'%Y-%m-%d'),'') AS released,
 id%2=0 AS installed, id%10=0 AS hidden, id%11=0 AS favorite, 'RPG; '||p_type AS genres, CASE WHEN feat IS NULL THEN '' ELSE feat||'; Cloud Saves' END AS features, '' AS tags, p_brand AS developers, '' AS publishers, 'PC' AS platforms FROM gs""")
def library_inventory(spark, sf):
    return G.inventory(T.games(spark, sf))


@REG.query("library_stores", f"WITH {GAMES} SELECT st AS store, count(*) AS games FROM gs GROUP BY 1")
def library_stores(spark, sf):
    return G.store_summary(T.games(spark, sf))


@REG.query("library_rating", f"WITH {GAMES} SELECT id, rating, stars FROM gs")
def library_rating(spark, sf):
    return G.rating(T.games(spark, sf)).select("id", "rating", "stars")


@REG.query("library_modes", f"""WITH {GAMES} SELECT id, coalesce(contains(lower(feat),'single'),false) AS single, coalesce(contains(lower(feat),'multi-player'),false) AS multi, coalesce(contains(lower(feat),'co-op'),false) AS coop, coalesce(regexp_matches(lower(feat),'pvp|versus'),false) AS pvp FROM gs""")
def library_modes(spark, sf):
    return G.mode_flags(T.games(spark, sf)).select("id", *G.MODES)


URL = "CASE WHEN id%3=0 THEN 'https://x/'||CAST(id AS VARCHAR)||CASE WHEN id%2=0 THEN '' ELSE '/gog' END WHEN store='Steam' THEN 'https://store.steampowered.com/app/'||CAST(id AS VARCHAR)||'/' ELSE '' END"


@REG.query("library_store_url", f"WITH {GAMES} SELECT id, {URL} AS store_url FROM gs")
def library_store_url(spark, sf):
    return G.store_url(T.games(spark, sf)).select("id", "store_url")


@REG.query("library_filter", f"WITH {GAMES} SELECT id FROM gs WHERE st IN ('Steam') AND contains(lower(feat),'single') AND stars>=1")
def library_filter(spark, sf):
    return G.filter_library(T.games(spark, sf), store="Steam", mode="single", min_stars=1).select("id")


@REG.query("library_filter_played", f"WITH {GAMES} SELECT id FROM gs WHERE contains(lower(name),'b') AND st IN ('Steam') AND id%2=0 AND sec>0")
def library_filter_played(spark, sf):
    return G.filter_library(T.games(spark, sf), name="B", store="Steam", installed=True, played=True).select("id")


@REG.query("library_sort", f"WITH {GAMES}, o AS (SELECT id, row_number() OVER (ORDER BY rating DESC NULLS LAST, id) AS n FROM gs) SELECT id, n AS position FROM o")
def library_sort(spark, sf):
    return G.sorted_positions(T.games(spark, sf), "score", descending=True)


@REG.query("library_activity", f"WITH {GAMES} SELECT count(*) FILTER (sec>0) AS played, count(*) FILTER (coalesce(sec,0)<=0) AS unplayed, CAST(coalesce(sum(sec),0) AS BIGINT) AS seconds FROM gs")
def library_activity(spark, sf):
    return G.activity(T.games(spark, sf))[0]


@REG.query("library_most_played", f"WITH {GAMES} SELECT id, sec AS playtime_sec FROM gs WHERE sec>0 ORDER BY sec DESC, id LIMIT 25")
def library_most_played(spark, sf):
    return G.activity(T.games(spark, sf))[1].select("id", "playtime_sec")


@REG.query("library_relative_age", f"""WITH {GAMES}, d AS (SELECT id, lp, DATE '2025-07-01'-lp AS n FROM gs), m AS (SELECT *, CAST(floor(n/30.44::DOUBLE) AS BIGINT) AS mo, CAST(floor(n/365.25::DOUBLE) AS BIGINT) AS yr FROM d)
SELECT id, CASE WHEN lp IS NULL THEN '' WHEN n<1 THEN 'today' WHEN n<2 THEN 'yesterday' WHEN n<30 THEN CAST(n AS VARCHAR)||' days ago' WHEN mo<12 THEN CAST(mo AS VARCHAR)||CASE WHEN mo=1 THEN ' month ago' ELSE ' months ago' END
 ELSE CAST(yr AS VARCHAR)||CASE WHEN yr=1 THEN ' year ago' ELSE ' years ago' END END AS age FROM m""")
def library_relative_age(spark, sf):
    return T.games(spark, sf).select("id", G.relative_age(F.col("last_played"), F.lit(dt.date(2025, 7, 1))).alias("age"))


@REG.query("library_totals", f"WITH {GAMES} SELECT count(*) AS total, count(*) FILTER (id%2=0) AS installed, count(*) FILTER ({URL}<>'') AS linked, count(DISTINCT st) AS stores FROM gs WHERE id%10<>0")
def library_totals(spark, sf):
    return G.gallery_totals(T.games(spark, sf))
