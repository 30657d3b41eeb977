"""Mail-filter feeds (Atom XML): read in splits cut at the entries, write one entry per element."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.operators.rulesets import ordered_props
from opsloom.session import cut_lineage

ENTRY = "`apps:property` array<struct<_name:string,_value:string>>"


# a feed root in front of everything but the declaration, comments and a document type
ROOT = r"(?s)^\uFEFF?\s*((<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)\s*)*<(\w+:)?feed\b[^>]*http://www\.w3\.org/2005/Atom"
HIDDEN = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>"


def _pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Feeds cut before each closing tag of an entry: the text source splits large files at that mark, so no task holds a feed."""
    return spark.read.text(path, lineSep="</entry").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))


def _file_facts(pieces: DataFrame) -> DataFrame:
    """Per file: ``feed`` (its root is an Atom feed) and ``hidden`` (a comment or CDATA section holds entry tags, or is cut by one)."""
    bare = F.regexp_replace("piece", HIDDEN, "")
    tags = lambda c: F.regexp_count(c, F.lit("<entry"))
    begins = F.col("piece").rlike(ROOT)
    return pieces.groupBy("file").agg(
        F.bool_or((F.col("block") == 0) & begins).alias("feed"),
        F.bool_or(bare.rlike(r"<!--|<!\[CDATA\[") | (tags("piece") != tags(bare)) | ~(begins | F.col("piece").rlike(r"^\s*>"))).alias("hidden"))


def _entries(pieces: DataFrame) -> DataFrame:
    """Entries of pieces: those closed in their own tag, then the one that ends the piece."""
    last = F.regexp_extract("piece", r"(?s)^.*(<entry(?:[\s/>].*)?)$", 1)
    closed = F.regexp_extract_all("piece", F.lit(r"<entry(\s[^<>]*)?/>"), F.lit(0))
    one = F.when((last != "") & ~last.rlike(r"^<entry(\s[^<>]*)?/>"), F.array(F.concat(last, F.lit("</entry>")))).otherwise(F.array().cast("array<string>"))
    return pieces.select("file", F.explode(F.concat(closed, one)).alias("entry")).select(
        "file", F.from_xml("entry", ENTRY, {"rowTag": "entry"})["apps:property"].alias("p"))


def read_filters(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per entry: id, file, pos (ascending within a file), props (first of equal names), clashes (names given twice with another value).

    A file without an Atom feed root is refused; an empty file holds no entries. Feeds are read in splits. Only files whose
    comments or CDATA sections hold entry tags go through Spark's XML source, which reads a file in one task.
    """
    pieces = _pieces(spark, path)
    facts = cut_lineage(_file_facts(pieces))
    if not facts.filter("NOT feed").isEmpty():
        raise ValueError("not a filter export: root element is not an Atom feed")
    hidden = facts.filter("hidden").select("file")
    entries = _entries(pieces.join(hidden, "file", "left_anti"))
    if not hidden.isEmpty():
        whole = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path).select(
            F.col("_metadata.file_path").alias("file"), F.col("apps:property").alias("p"))
        entries = entries.unionByName(whole.join(hidden, "file", "left_semi"))
    return from_properties(entries.withColumn("pos", F.monotonically_increasing_id()))


def from_properties(entries: DataFrame) -> DataFrame:
    """Entries with ``p`` array<struct<_name,_value>> -> props and clashes."""
    named = F.filter("p", lambda x: F.coalesce(x["_name"], F.lit("")) != "")
    names = F.array_distinct(F.transform(named, lambda x: x["_name"]))
    first = lambda n: F.coalesce(F.filter(named, lambda x: x["_name"] == n)[0]["_value"], F.lit(""))
    props = F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), first(n).alias("value"))))
    twice = F.filter(names, lambda n: F.size(F.array_distinct(F.transform(F.filter(named, lambda x: x["_name"] == n), lambda x: F.coalesce(x["_value"], F.lit(""))))) > 1)
    rest = [c for c in entries.columns if c != "p"]
    return entries.select(F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in rest]), 256).alias("id"), *rest,
                          F.coalesce(props, F.create_map().cast("map<string,string>")).alias("props"), twice.alias("clashes"))


def write_filters(filters: DataFrame, path: str) -> None:
    """Entries in position order, properties in export order, as a feed with Spark's XML writer."""
    rows = filters.orderBy("pos").select(
        F.lit("Mail Filter").alias("title"),
        F.transform(ordered_props(F.col("props")), lambda e: F.struct(e["key"].alias("_name"), e["value"].alias("_value"))).alias("apps:property"))
    root = "feed xmlns='http://www.w3.org/2005/Atom' xmlns:apps='http://schemas.google.com/apps/2006'"
    rows.write.mode("overwrite").format("xml").option("rootTag", root).option("rowTag", "entry").option("validateName", False).save(path)
