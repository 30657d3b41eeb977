"""Registered dashboard and category maintenance queries."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.checks.registry import Registry
from opsloom.checks.views import CATEGORIES, LEDGER, TREE
from opsloom.operators import categories as C
from opsloom.plans import dashboard as D
from opsloom.sources import tables as T

REG = Registry()


@REG.query("dashboard", f"""WITH {LEDGER}, {CATEGORIES}, l AS (SELECT *, strftime(date,'%Y-%m') AS month FROM v_ledger),
f AS (SELECT month, sum(CASE WHEN direction='income' THEN amount_cents ELSE 0 END) AS inc, -sum(CASE WHEN direction='expense' THEN amount_cents ELSE 0 END) AS sp FROM l GROUP BY 1)
SELECT section, label, CAST(cents AS BIGINT) AS cents FROM (
 SELECT CASE month WHEN '1998-06' THEN 'current' ELSE 'previous' END AS section, 'income' AS label, inc AS cents FROM f WHERE month IN ('1998-06','1998-05')
 UNION ALL SELECT CASE month WHEN '1998-06' THEN 'current' ELSE 'previous' END, 'spending', sp FROM f WHERE month IN ('1998-06','1998-05')
 UNION ALL SELECT 'months', month, inc-sp FROM f WHERE month BETWEEN '1997-07' AND '1998-06'
 UNION ALL SELECT 'categories', coalesce(path,'Uncategorized'), -sum(amount_cents) FROM l LEFT JOIN v_path p ON p.id=l.category_id WHERE month='1998-06' AND direction='expense' GROUP BY 2
 UNION ALL SELECT * FROM (SELECT 'merchants', merchant, -sum(amount_cents) AS c FROM l WHERE month='1998-06' AND direction='expense' GROUP BY 2 ORDER BY c DESC, merchant LIMIT 5))""")
def dashboard(spark, sf):
    parts = D.totals(D.monthly_cube(T.ledger(spark, sf)), T.categories(spark, sf), "1998-06")
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("section"), "label", "cents") for name, df in parts.items()])


def user_tree(spark, sf):
    """The region tree as one user's categories: regions built in, some nodes with a group, nations in two spellings."""
    n = F.regexp_extract("id", r"\d+", 0).cast("int")
    nation = F.col("id").startswith("N")
    return T.tree(spark, sf).select(
        "id", F.when(nation, F.when(n % 2 == 0, "land").otherwise("Land")).otherwise(F.col("name")).alias("name"),
        "parent_id", F.when(~F.col("id").startswith("R"), "u1").alias("user_id"),
        F.when(nation & (n % 3 == 0), "-").when(nation & (n % 3 == 1), F.concat(F.lit("G"), n.cast("string"))).alias("system_group"),
        F.when(n % 4 == 0, "import").alias("origin"), F.lit("expense").alias("kind"))


UTREE = TREE + """, nn AS (SELECT *, CAST(substr(id,2) AS INTEGER) AS n FROM v_tree),
ut AS (SELECT id, CASE WHEN id LIKE 'N%' THEN CASE WHEN n%2=0 THEN 'land' ELSE 'Land' END ELSE name END AS name, parent_id, CASE WHEN id NOT LIKE 'R%' THEN 'u1' END AS user_id,
 CASE WHEN id LIKE 'N%' AND n%3=0 THEN '-' WHEN id LIKE 'N%' AND n%3=1 THEN 'G'||CAST(n AS VARCHAR) END AS system_group, CASE WHEN n%4=0 THEN 'import' END AS origin FROM nn)
"""


@REG.query("category_groups", f"""WITH {UTREE}, g AS (SELECT c.id, CASE WHEN c.id LIKE 'R%' THEN c.name WHEN c.system_group IS NOT NULL THEN c.system_group WHEN p.id LIKE 'R%' THEN p.name WHEN p.system_group IS NOT NULL THEN p.system_group ELSE r.name END AS e
 FROM ut c LEFT JOIN ut p ON c.parent_id=p.id LEFT JOIN ut r ON p.parent_id=r.id) SELECT id, NULLIF(e,'-') AS effective_group FROM g""")
def category_groups(spark, sf):
    return C.category_groups(user_tree(spark, sf)).select("id", "effective_group")


@REG.query("visible_categories", f"""WITH {UTREE}, t AS (SELECT * REPLACE (CASE WHEN id='N7' THEN NULL ELSE parent_id END AS parent_id, CASE WHEN id='N7' THEN 'asia' ELSE name END AS name) FROM ut)
SELECT id FROM t WHERE id NOT IN ('S1','R0') AND NOT (user_id IS NULL AND lower(name)='asia')""")
def visible_categories(spark, sf):
    cats = user_tree(spark, sf)
    own = F.col("id") == "N7"
    cats = cats.withColumn("parent_id", F.when(~own, F.col("parent_id"))).withColumn("name", F.when(own, "asia").otherwise(F.col("name")))
    hidden = T.tree(spark, sf).filter(F.col("id").isin("S1", "R0")).select(F.lit("u1").alias("user_id"), F.col("id").alias("category_id"))
    users = cats.filter(F.col("user_id").isNotNull()).select("user_id").distinct()
    return C.visible_categories(cats, hidden, users).select("id")


def uses(spark, sf):
    line = T.table(spark, sf, "lineitem")
    return line.select(F.lit("u1").alias("user_id"), F.concat(F.lit("N"), F.pmod("l_suppkey", F.lit(20)).cast("string")).alias("category_id"),
                       F.lit(-1).cast("long").alias("amount_cents"), F.lit("expense").alias("direction"))


@REG.query("dedupe_categories", f"""WITH {UTREE}, us AS (SELECT 'N'||CAST(l_suppkey%20 AS VARCHAR) AS id, count(*) AS used FROM lineitem GROUP BY 1),
j AS (SELECT ut.*, coalesce(used,0) AS used FROM ut LEFT JOIN us USING (id) WHERE user_id IS NOT NULL),
k AS (SELECT *, first_value(id) OVER (PARTITION BY lower(name), parent_id ORDER BY used DESC, (name<>lower(name)) DESC, coalesce(origin='import',false) DESC, name DESC, id DESC) AS keep FROM j)
SELECT 'u1' AS user_id, id AS src_id, keep AS dst_id FROM k WHERE id<>keep""")
def dedupe_categories(spark, sf):
    return C.dedupe_categories(user_tree(spark, sf), uses(spark, sf))


@REG.query("merge_categories", """SELECT category_id, count(*) AS n FROM (SELECT CASE WHEN l_suppkey%20 IN (3,4) THEN 'N5' ELSE 'N'||CAST(l_suppkey%20 AS VARCHAR) END AS category_id FROM lineitem) GROUP BY 1""")
def merge_categories(spark, sf):
    cats = user_tree(spark, sf)
    moves = cats.filter(F.col("id").isin("N3", "N4")).select("user_id", F.col("id").alias("src_id"), F.lit("N5").alias("dst_id"))
    none = cats.select("user_id", "id", F.col("id").alias("category_id"))
    return C.merge_categories(uses(spark, sf), none, none, cats, moves)["transactions"].groupBy("category_id").agg(F.count("*").alias("n"))
