"""Hygiene of mail-filter rule sets: sparse property maps with an id and a position."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: property names, criteria first, in export order
PROPERTY_ORDER = [
    "from", "to", "subject", "hasTheWord", "doesNotHaveTheWord", "size", "sizeOperator", "sizeUnit", "hasAttachment", "excludeChats",
    "label", "shouldArchive", "shouldMarkAsRead", "shouldStar", "shouldTrash", "shouldNeverSpam", "shouldAlwaysMarkAsImportant",
    "shouldNeverMarkAsImportant", "smartLabelToApply", "forwardTo", "cannedResponse",
]
CRITERIA = ["from", "to", "subject", "hasTheWord", "doesNotHaveTheWord", "size", "hasAttachment"]
NOT_ACTIONS = [*CRITERIA, "sizeOperator", "sizeUnit", "excludeChats"]
TEXTS = ["from", "to", "subject", "hasTheWord", "doesNotHaveTheWord"]
TEXT_LIMIT = 1500


def clean_props(props: Column) -> Column:
    """Trimmed names; empty and "false" values dropped."""
    entries = F.filter(F.transform(F.map_entries(props), lambda e: F.struct(F.trim(e["key"]).alias("key"), F.coalesce(e["value"], F.lit("")).alias("value"))),
                       lambda e: (e["key"] != "") & (e["value"] != "") & (F.lower(e["value"]) != "false"))
    return F.map_from_entries(entries)


def canonical_key(props: Column) -> Column:
    """Text that is equal for equal property sets, whatever their order."""
    return F.to_json(F.array_sort(F.map_entries(props)))


def merge_filters(current: DataFrame, new: DataFrame) -> DataFrame:
    """``current`` plus the filters of ``new`` whose property set it lacks, each set once (first position kept)."""
    have = current.select(F.sha2(canonical_key(F.col("props")), 256).alias("__k")).distinct()
    rest = [c for c in new.columns]
    fresh = new.withColumn("__k", F.sha2(canonical_key(F.col("props")), 256)).join(have, "__k", "left_anti")
    first = fresh.groupBy("__k").agg(F.min_by(F.struct(*rest), F.struct("pos", "id")).alias("r")).select("r.*")
    base = current.agg(F.coalesce(F.max("pos"), F.lit(0))).scalar()
    return current.unionByName(first.withColumn("pos", F.col("pos") + base))


def _has(props: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(props, F.lit(key)), F.lit("")) != ""


def _text_length(props: Column) -> Column:
    return sum((F.length(F.coalesce(F.try_element_at(props, F.lit(k)), F.lit(""))) for k in TEXTS[1:]),
               F.length(F.coalesce(F.try_element_at(props, F.lit(TEXTS[0])), F.lit(""))))


def _problem_flags(p: Column) -> tuple[Column, Column, Column]:
    criteria = F.exists(F.array(*[F.lit(k) for k in CRITERIA]), lambda k: F.coalesce(F.try_element_at(p, k), F.lit("")) != "")
    action = F.exists(F.map_keys(p), lambda k: ~k.isin(NOT_ACTIONS))
    return ~criteria, ~action, _text_length(p) > TEXT_LIMIT


def import_problems(filters: DataFrame) -> DataFrame:
    """Add ``problems``: reasons an import would refuse the filter. An unknown property counts as an action."""
    none, idle, long = _problem_flags(F.col("__p"))
    return filters.withColumn("__p", clean_props(F.col("props"))).withColumn("problems", F.array_compact(F.array(
        F.when(none, "no criteria"), F.when(idle, "no action"), F.when(long, f"criteria over {TEXT_LIMIT} characters")))).drop("__p")


def conflict_warnings(filters: DataFrame) -> DataFrame:
    """Add ``warnings``: the problems plus contradictions and exact duplicates.

    Duplicates are counted per hash of the property set with a map-side combine and joined back.
    """
    keyed = filters.withColumn("__p", clean_props(F.col("props"))).withColumn("__k", F.sha2(canonical_key(F.col("__p")), 256))
    copies = keyed.groupBy("__k").agg(F.count("*").alias("copies"))
    p = F.col("__p")
    none, idle, long = _problem_flags(p)
    listed = F.array_compact(F.array(
        F.when(none, "no criteria"), F.when(idle, "no action"), F.when(long, f"criteria over {TEXT_LIMIT} characters"),
        F.when(_has(p, "shouldTrash") & _has(p, "shouldNeverSpam"), "delete and never spam"),
        F.when(_has(p, "shouldAlwaysMarkAsImportant") & _has(p, "shouldNeverMarkAsImportant"), "important both ways"),
        F.when(_has(p, "size") & ~(_has(p, "sizeOperator") & _has(p, "sizeUnit")), "size without operator or unit"),
        F.when(F.col("copies") > 1, "exact duplicate")))
    return keyed.join(copies, "__k").withColumn("warnings", listed).drop("__p", "__k")


def rename_label(filters: DataFrame, old: str, new: str, nested: bool = False) -> DataFrame:
    """Rename a label exactly, with ``nested`` also below ``old/``."""
    def renamed(value: Column) -> Column:
        out = F.when(value == old, F.lit(new))
        if nested:
            out = out.when(value.startswith(old + "/"), F.concat(F.lit(new), F.substring(value, F.lit(len(old) + 1), F.length(value))))
        return out.otherwise(value)
    return filters.withColumn("props", F.transform_values("props", lambda k, v: F.when(k == "label", renamed(v)).otherwise(v)))


def search_filters(filters: DataFrame, text: str | None = None, view: str | None = None, sort: str = "#", descending: bool = False) -> DataFrame:
    """Filters whose "name value" pairs contain the text; views: warn, dupe, nolabel; sort by position or a property."""
    out = conflict_warnings(filters)
    if text:
        needle = F.lit(text.lower())
        out = out.filter(F.exists(F.map_entries("props"), lambda e: F.contains(F.lower(F.concat(e["key"], F.lit(" "), e["value"])), needle)))
    if view == "warn":
        out = out.filter(F.size("warnings") > 0)
    elif view == "dupe":
        out = out.filter(F.col("copies") > 1)
    elif view == "nolabel":
        out = out.filter(~_has(F.col("props"), "label"))
    key = F.col("pos") if sort == "#" else F.lower(F.coalesce(F.try_element_at("props", F.lit(sort)), F.lit("")))
    return out.withColumn("sort_key", key.cast("string")).orderBy(F.desc(key) if descending else F.asc(key), "pos")


def ordered_props(props: Column) -> Column:
    """Cleaned properties as entries in export order, unknown names after the known ones by name."""
    def place(e: Column) -> Column:
        at = F.array_position(F.array(*[F.lit(k) for k in PROPERTY_ORDER]), e["key"])
        return F.struct(F.when(at > 0, at).otherwise(len(PROPERTY_ORDER) + 1).alias("n"), e["key"].alias("key"), e["value"].alias("value"))
    return F.transform(F.array_sort(F.transform(F.map_entries(clean_props(props)), place)), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def export_filters(filters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(exportable filters with ordered properties, refused filters with position and problems)."""
    checked = import_problems(filters)
    good = checked.filter(F.size("problems") == 0).select("id", "pos", ordered_props(F.col("props")).alias("properties"))
    bad = checked.filter(F.size("problems") > 0).select("id", "pos", "problems")
    return good, bad


def export_counts(filters: DataFrame) -> DataFrame:
    return import_problems(filters).agg(F.count_if(F.size("problems") == 0).alias("exported"), F.count_if(F.size("problems") > 0).alias("skipped"))
